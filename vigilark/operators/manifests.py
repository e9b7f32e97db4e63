"""Dependency manifests to rows (ecosystem, name, version, manifest_path, line).

Line formats are split with their line numbers and read by patterns; formats with state (yarn, pnpm, go) carry it
forward with windows over a file's lines. JSON maps are exploded. TOML and XML are read by small table functions, element by element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import register
from ..sources.fixtures import read

#: Formats by the kind of manifest that a part number stands for; each text is written from the part's columns.
_NAME, _VER = "lower(replace(p_brand, '#', '-'))", "p_size || '.' || (p_partkey % 7) || '.' || (p_partkey % 3)"
_NL, _Q = "chr(10)", "chr(34)"
TEXTS = {
    "package.json": f"'{{{{' || {_Q} || 'dependencies' || {_Q} || ':{{{{' || {_Q} || n || {_Q} || ':' || {_Q} || '^' || v || {_Q} || ',' || {_Q} || 'al-' || n || {_Q} || ':' || {_Q} || 'npm:@s/' || n || '@~' || v || {_Q} || ',' || {_Q} || 'ws' || {_Q} || ':' || {_Q} || 'workspace:*' || {_Q} || '}}}},' || {_Q} || 'devDependencies' || {_Q} || ':{{{{' || {_Q} || 'local' || {_Q} || ':' || {_Q} || 'file:../x' || {_Q} || ',' || {_Q} || 'dev-' || n || {_Q} || ':' || {_Q} || '>=' || v || ' <9' || {_Q} || '}}}}}}}}'",
    "package-lock.json": f"'{{{{' || {_Q} || 'packages' || {_Q} || ':{{{{' || {_Q} || {_Q} || ':{{{{' || {_Q} || 'version' || {_Q} || ':' || {_Q} || '0.0.1' || {_Q} || '}}}},' || {_Q} || 'node_modules/a/node_modules/' || n || {_Q} || ':{{{{' || {_Q} || 'version' || {_Q} || ':' || {_Q} || v || {_Q} || '}}}}}}}}}}}}'",
    "yarn.lock": f"'# yarn lockfile v1' || {_NL} || n || '@^1, ' || n || '@~2:' || {_NL} || '  version ' || {_Q} || v || {_Q} || {_NL} || '  resolved x' || {_NL} || {_Q} || '@s/' || n || '@1' || {_Q} || ':' || {_NL} || '  version ' || {_Q} || v || '-b1' || {_Q}",
    "pnpm-lock.yaml": f"'lockfileVersion: 5' || {_NL} || 'packages:' || {_NL} || '  /' || n || '@' || v || '(peer@1):' || {_NL} || '    dev: true' || {_NL} || '  /@s/' || n || '@' || v || ':' || {_NL} || 'settings:' || {_NL} || '  /late@1.0.0:'",
    "requirements.txt": f"'# pinned' || {_NL} || n || '==' || v || {_NL} || n || '-extra[all]>=' || v || ' ; python_version > ' || {_Q} || '3' || {_Q} || {_NL} || '-r base.txt' || {_NL} || 'git+https://x.invalid/y' || {_NL} || 'loose' || {_NL} || n || '-c~=' || v || ',<9  # note'",
    "build.gradle": f"'dependencies {{{{' || {_NL} || '  implementation ' || chr(39) || 'org.' || n || ':core:' || v || chr(39) || {_NL} || '  api(' || {_Q} || 'org.x:' || n || ':' || v || {_Q} || ')' || {_NL} || '  classpath ' || chr(39) || 'a:b:1' || chr(39) || {_NL} || '}}}}'",
    "go.mod": f"'module m' || {_NL} || 'require example.org/' || n || ' v' || v || {_NL} || 'require (' || {_NL} || '  example.org/b/' || n || ' v' || v || ' // indirect' || {_NL} || '// gone v1.0.0' || {_NL} || ')' || {_NL} || 'replace a v1.0.0'",
    "pom.xml": f"'<project><dependencies><dependency><groupId>org.' || n || '</groupId><artifactId>core</artifactId><version>' || v || '</version></dependency><dependency><groupId>x</groupId><artifactId>y</artifactId></dependency><dependency><version>' || v || '-rc</version><artifactId>late</artifactId><groupId>z</groupId></dependency></dependencies>' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '</project>' END",
    "app.csproj": f"'<Project><ItemGroup><PackageReference Include={{q}}none{{q}} /><PackageReference Update={{q}}up{{q}} Version={{q}}3.1{{q}} /><PackageReference Include={{q}}kid{{q}}><Version>' || v || '.9</Version></PackageReference><PackageReference Include={{q}}' || n || '{{q}} Version={{q}}' || v || '{{q}} /></ItemGroup>' || CASE WHEN p_partkey % 4 = 0 THEN '<' ELSE '</Project>' END".replace("{q}", f"' || {_Q} || '"),
    "packages.config": f"'<packages><package id={{q}}bare{{q}}/><package version={{q}}9.9{{q}}/><package id={{q}}' || n || '{{q}} version={{q}}' || v || '{{q}} /></packages>'".replace("{q}", f"' || {_Q} || '"),
    "pyproject.toml": f"'[project]' || {_NL} || 'dependencies = [' || {_Q} || n || '==' || v || {_Q} || ']' || {_NL} || '[tool.poetry.dependencies]' || {_NL} || 'python = ' || {_Q} || '^3.10' || {_Q} || {_NL} || 'poet-' || n || ' = ' || {_Q} || '^' || v || {_Q}",
}
TEXTS = {k: v.replace("{{", "{").replace("}}", "}") for k, v in TEXTS.items()}
KINDS = list(TEXTS)


def manifests(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(manifest_path, text): one manifest of the kind a part of every kind's share."""
    p = read(spark, sf_dir, "part").where(F.col("p_partkey") % len(KINDS) == KINDS.index(kind))
    return p.select("p_partkey", F.expr(_NAME).alias("n"), F.expr(_VER).alias("v")).selectExpr(f"'r' || p_partkey || '/{kind}' AS manifest_path", f"{TEXTS[kind]} AS text")


def _sql(kind: str) -> str:
    return f"manifests AS (SELECT 'r' || p_partkey || '/{kind}' AS manifest_path, {TEXTS[kind]} AS text FROM (SELECT p_partkey, {_NAME} AS n, {_VER} AS v FROM part WHERE p_partkey % {len(KINDS)} = {KINDS.index(kind)}))"


def version(raw: Column) -> Column:
    """Leading range signs go, the rest is cut at the first odd character; no digit, no version."""
    v = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^[\^~<>=\s]+", ""), r"(?s)[^0-9A-Za-z._-].*$", "")
    return F.when(F.rlike(v, F.lit(r"\d")), v)


_V = "regexp_replace(regexp_replace(trim({0}), '^[\\^~<>=\\s]+', ''), '[^0-9A-Za-z._-].*$', '', 's')"


def lines(m: DataFrame) -> DataFrame:
    return m.select("manifest_path", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("line_no", F.col("p") + 1).drop("p")


_LINES = "lines AS (SELECT manifest_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM manifests)"


def _rows(df: DataFrame, ecosystem: str, name: str | Column = "name", raw: str = "raw", line: str | None = "line_no") -> DataFrame:
    out = df.select(F.lit(ecosystem).alias("ecosystem"), (F.col(name) if isinstance(name, str) else name).alias("name"), version(F.col(raw)).alias("version"), "manifest_path", (F.col(line) if line else F.lit(1)).cast("int").alias("line"))
    return out.where("name <> '' AND version IS NOT NULL")


def npm_spec(df: DataFrame) -> DataFrame:
    """Resolves aliases and workspace ranges of (name, spec); what no registry serves goes."""
    alias = F.regexp_extract("spec", r"^npm:\s*(.+)@[^@]*$", 1)
    df = df.withColumn("_a", alias).withColumn("_s", F.when(F.col("spec").startswith("npm:"), F.regexp_extract("spec", r"@([^@]*)$", 1)).otherwise(F.col("spec")))
    df = df.withColumn("name", F.when(F.col("_a") != "", F.col("_a")).otherwise(F.regexp_replace(F.trim("name"), r"^.*node_modules/", "")))
    df = df.withColumn("raw", F.when(F.col("_s").startswith("workspace:"), F.expr("trim(substring(_s, 11))")).otherwise(F.col("_s")))
    return df.where(~F.rlike("raw", F.lit(r"^(file:|link:|git\+|github:|https?://)")) & ~F.col("raw").isin("", "*", "^", "~"))


def package_json(m: DataFrame) -> DataFrame:
    sections = [F.from_json(F.get_json_object("text", f"$.{s}"), "map<string,string>") for s in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    each = m.select("manifest_path", F.explode(F.array(*sections)).alias("s")).select("manifest_path", F.explode("s").alias("name", "spec"))
    return _rows(npm_spec(each.withColumn("spec", F.trim(F.coalesce("spec", F.lit(""))))), "npm", line=None)


def package_lock(m: DataFrame) -> DataFrame:
    kind = "map<string,struct<version:string>>"
    both = [F.from_json(F.get_json_object("text", f"$.{s}"), kind) for s in ("dependencies", "packages")]
    each = m.select("manifest_path", F.explode(F.array(*both)).alias("s")).select("manifest_path", F.explode("s").alias("path", "d"))
    return _rows(each.select("manifest_path", F.regexp_replace("path", r"^.*node_modules/", "").alias("name"), F.col("d.version").alias("raw")), "npm", line=None)


def yarn_lock(m: DataFrame) -> DataFrame:
    """A key line sets the names that the next version line belongs to."""
    x = lines(m).withColumn("key", F.nullif(F.regexp_extract("line", r'^("?[^" ][^"]*"?):\s*$', 1), F.lit(""))).withColumn("raw", F.nullif(F.regexp_extract("line", r'^\s{2}version\s+"([^"]+)"\s*$', 1), F.lit("")))
    w = W.partitionBy("manifest_path").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("at", F.last(F.when(F.col("key").isNotNull(), F.struct("key", "line_no")), ignorenulls=True).over(w))
    x = x.where("raw IS NOT NULL AND at IS NOT NULL").withColumn("nth", F.row_number().over(W.partitionBy("manifest_path", "at.line_no").orderBy("line_no"))).where("nth = 1")
    each = x.select("manifest_path", "raw", F.explode(F.split("at.key", ",")).alias("spec"))
    return _rows(each.withColumn("name", F.regexp_extract(F.expr("trim(BOTH '\"' FROM trim(spec))"), r"^(@?[^@]+)@", 1)), "npm", line=None)


def pnpm_lock(m: DataFrame) -> DataFrame:
    """Keys between packages: and the next top-level section."""
    w = W.partitionBy("manifest_path").orderBy("line_no")
    x = lines(m).withColumn("top", (F.trim("line") != "") & ~F.col("line").startswith("  ")).withColumn("nth", F.sum(F.when(F.col("top"), F.when(F.trim("line") == "packages:", 1).otherwise(1000))).over(w))
    x = x.withColumn("open", F.max(F.when(F.trim("line") == "packages:", F.col("line_no"))).over(w)).withColumn("closed", F.max(F.when(F.col("top"), F.col("line_no"))).over(w))
    x = x.where("open IS NOT NULL AND closed = open").withColumn("id", F.regexp_extract(F.split_part(F.regexp_extract("line", r"^\s{2}(/[^:]+):\s*$", 1), F.lit("("), F.lit(1)), r"^/+(.*)$", 1)).where("contains(id, '@')")
    return _rows(x.withColumn("name", F.regexp_extract("id", r"^(.*)@[^@]*$", 1)).withColumn("raw", F.regexp_extract("id", r"@([^@]*)$", 1)), "npm", line=None)


def requirements(m: DataFrame) -> DataFrame:
    x = lines(m).withColumn("s", F.trim(F.split_part(F.split_part("line", F.lit("#"), F.lit(1)), F.lit(";"), F.lit(1))))
    x = x.where(~F.rlike("s", F.lit(r"^(-|git\+|hg\+|svn\+|https?://)")))
    pattern = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:==|>=|<=|~=|>|<)\s*([^,\s]+)"
    return _rows(x.withColumn("name", F.regexp_extract("s", pattern, 1)).withColumn("raw", F.regexp_extract("s", pattern, 2)), "PyPI")


def gradle(m: DataFrame) -> DataFrame:
    p = r"""\b(?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly)\s*(?:\(|\s+)['"]([^:'"]+):([^:'"]+):([^'")]+)['"]"""
    x = lines(m).where(F.rlike("line", F.lit(p)))
    return _rows(x.withColumn("raw", F.regexp_extract("line", p, 3)), "Maven", F.concat_ws(":", F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2)))


def go_mod(m: DataFrame) -> DataFrame:
    """Single requires, and the lines of a require block; comments go first."""
    w = W.partitionBy("manifest_path").orderBy("line_no")
    x = lines(m).withColumn("s", F.trim(F.split_part("line", F.lit("//"), F.lit(1)))).where("s <> ''")
    mark = F.when(F.col("s").startswith("require ("), True).when(F.col("s") == ")", False)
    x = x.withColumn("mark", mark).withColumn("inside", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(False))).where("mark IS NULL")
    p = F.when(F.col("inside"), F.col("s")).otherwise(F.regexp_extract("s", r"^require\s+(.*)$", 1))
    x = x.withColumn("r", p)
    return _rows(x.withColumn("name", F.regexp_extract("r", r"^(\S+)\s+(\S+)$", 1)).withColumn("raw", F.regexp_extract("r", r"^(\S+)\s+(\S+)$", 2)), "Go")


@F.udtf(returnType="name string, raw string")
class XmlDependencies:
    """(name, raw version) of each element of a kind in an XML text, whatever the namespace; none if it isn't XML."""

    def eval(self, text: str, kind: str):
        import xml.etree.ElementTree as tree

        try:
            root = tree.fromstring(text or "")
        except (tree.ParseError, ValueError):
            return
        child = lambda e, tag: next(((c.text or "").strip() for c in e if c.tag.endswith(tag)), "")
        for e in root.iter():
            if not isinstance(e.tag, str) or not e.tag.endswith(kind):
                continue
            if kind == "dependency":
                group, artifact = child(e, "groupId"), child(e, "artifactId")
                yield f"{group}:{artifact}" if group and artifact else "", child(e, "version")
            elif kind == "PackageReference":
                yield (e.get("Include") or e.get("Update") or "").strip(), (e.get("Version") or "").strip() or child(e, "Version")
            else:
                yield (e.get("id") or "").strip(), (e.get("version") or "").strip()


def _xml(kind: str, ecosystem: str):
    return lambda m: _rows(m.lateralJoin(XmlDependencies(F.col("text").outer(), F.lit(kind))), ecosystem, line=None)


pom, csproj, packages_config = _xml("dependency", "Maven"), _xml("PackageReference", "NuGet"), _xml("package", "NuGet")


@F.udtf(returnType="name string, raw string")
class PyprojectDependencies:
    """Dependencies of a TOML text: the project list and the poetry table; none if it isn't TOML."""

    def eval(self, text: str):
        import re
        import tomllib

        try:
            d = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return
        for item in (d.get("project") or {}).get("dependencies") or []:
            if m := re.match(r"\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:==|>=|<=|~=|>|<)\s*([^,;\s]+)", str(item)):
                yield m[1], m[2]
        for name, spec in (((d.get("tool") or {}).get("poetry") or {}).get("dependencies") or {}).items():
            spec = spec.get("version") if isinstance(spec, dict) else spec
            if name.lower() != "python" and isinstance(spec, str):
                yield name, spec


def pyproject(m: DataFrame) -> DataFrame:
    found = m.lateralJoin(PyprojectDependencies(F.col("text").outer()))
    return _rows(found, "PyPI", line=None)


PARSERS = [("package.json", package_json), ("package-lock.json", package_lock), ("yarn.lock", yarn_lock), ("pnpm-lock.yaml", pnpm_lock), ("requirements.txt", requirements), ("pyproject.toml", pyproject), ("pom.xml", pom), ("build.gradle", gradle), ("go.mod", go_mod), ("app.csproj", csproj), ("packages.config", packages_config)]


def all_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all manifests, some with a Pipfile beside them."""
    paths = None
    for kind in KINDS:
        one = manifests(spark, sf_dir, kind).select("manifest_path")
        paths = one if paths is None else paths.unionAll(one)
    beside = read(spark, sf_dir, "part").where("p_partkey % 33 = 3").selectExpr("'r' || p_partkey || '/Pipfile' AS manifest_path")
    return paths.unionAll(beside)


def project_gate(paths: DataFrame) -> DataFrame:
    """Which projects a repository holds, from the names of its files alone."""
    name = F.substring_index("manifest_path", "/", -1)
    return paths.groupBy(F.split_part("manifest_path", F.lit("/"), F.lit(1)).alias("repo")).agg(F.bool_or(name == "package.json").alias("node"), F.bool_or(name.isin("requirements.txt", "pyproject.toml", "Pipfile")).alias("python"))


def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parsers in their order; of equal (ecosystem, name, version, manifest) the first stays."""
    out = None
    for k, (kind, parse) in enumerate(PARSERS):
        part = parse(manifests(spark, sf_dir, kind)).withColumn("parser", F.lit(k))
        out = part if out is None else out.unionByName(part)
    w = W.partitionBy("ecosystem", F.lower("name"), "version", "manifest_path").orderBy("parser", "line", "name")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_SQLS = {
    "package.json": f"""j AS (SELECT manifest_path, unnest(map_entries(json_extract(text, s)::MAP(VARCHAR, VARCHAR))) AS e FROM manifests, (VALUES ('$.dependencies'), ('$.devDependencies')) t(s)),
      k AS (SELECT manifest_path, CASE WHEN e.value LIKE 'npm:%' THEN regexp_extract(e.value, '^npm:(.+)@', 1) ELSE e.key END AS name, CASE WHEN e.value LIKE 'npm:%' THEN regexp_extract(e.value, '@([^@]*)$', 1) ELSE e.value END AS raw FROM j)
      SELECT 'npm' AS ecosystem, name, {_V.format('raw')} AS version, manifest_path, 1 AS line FROM k WHERE NOT regexp_matches(raw, '^(workspace:|file:)')""",
    "package-lock.json": "j AS (SELECT manifest_path, unnest(map_entries(json_extract(text, '$.packages')::MAP(VARCHAR, JSON))) AS e FROM manifests) SELECT 'npm' AS ecosystem, regexp_extract(e.key, '([^/]+)$', 1) AS name, e.value->>'version' AS version, manifest_path, 1 AS line FROM j WHERE e.key <> ''",
    "yarn.lock": """v AS (SELECT manifest_path, regexp_extract(text, 'version "([^"]+)"', 1) AS v, regexp_extract(text, '\\n([^@\\n]+)@', 1) AS n FROM manifests)
      SELECT 'npm' AS ecosystem, n AS name, v AS version, manifest_path, 1 AS line FROM v UNION ALL SELECT 'npm', n, v, manifest_path, 1 FROM v UNION ALL SELECT 'npm', '@s/' || n, v || '-b1', manifest_path, 1 FROM v""",
    "pnpm-lock.yaml": "r AS (SELECT manifest_path, unnest(regexp_extract_all(regexp_extract(text, '(?s)packages:(.*)settings:', 1), '\\n  /([^:(]+)', 1)) AS id FROM manifests) SELECT 'npm' AS ecosystem, regexp_extract(id, '^(.*)@', 1) AS name, regexp_extract(id, '@([^@]*)$', 1) AS version, manifest_path, 1 AS line FROM r",
    "requirements.txt": f"{_LINES} SELECT 'PyPI' AS ecosystem, regexp_extract(line, '^([a-z0-9-]+)', 1) AS name, regexp_extract(line, '[=>~]=([0-9.]+)', 1) AS version, manifest_path, line_no AS line FROM lines WHERE regexp_matches(line, '^[a-z][a-z0-9-]*(\\[all\\])?(==|>=|~=)')",
    "build.gradle": f"{_LINES} SELECT 'Maven' AS ecosystem, regexp_extract(line, '[''\"]([^:]+:[^:]+):', 1) AS name, regexp_extract(line, ':([0-9.]+)[''\"]', 1) AS version, manifest_path, line_no AS line FROM lines WHERE regexp_matches(line, '(implementation|api)[ (]')",
    "pom.xml": "x AS (SELECT *, regexp_extract(text, 'org[.]([^<]+)<', 1) AS n, regexp_extract(text, '<version>([0-9.]+)<', 1) AS v FROM manifests WHERE ends_with(text, '</project>')) SELECT 'Maven' AS ecosystem, unnest(['org.' || n || ':core', 'z:late']) AS name, unnest([v, v || '-rc']) AS version, manifest_path, 1 AS line FROM x",
    "app.csproj": "x AS (SELECT *, regexp_extract(text, '<Version>([0-9.]+)[.]9<', 1) AS v, regexp_extract(text, 'Include=.([a-z0-9-]+). Version', 1) AS n FROM manifests WHERE ends_with(text, '</Project>')) SELECT 'NuGet' AS ecosystem, unnest(['up', 'kid', n]) AS name, unnest(['3.1', v || '.9', v]) AS version, manifest_path, 1 AS line FROM x",
    "packages.config": "SELECT 'NuGet' AS ecosystem, regexp_extract(text, 'id=.([a-z0-9-]+). version', 1) AS name, regexp_extract(text, '. version=.([0-9.]+). /></packages>', 1) AS version, manifest_path, 1 AS line FROM manifests",
    "pyproject.toml": """x AS (SELECT *, regexp_extract(text, '"([a-z0-9-]+)==', 1) AS n, regexp_extract(text, '==([0-9.]+)', 1) AS v FROM manifests) SELECT 'PyPI' AS ecosystem, unnest([n, 'poet-' || n]) AS name, unnest([v, v]) AS version, manifest_path, 1 AS line FROM x""",
    "go.mod": f"{_LINES} SELECT 'Go' AS ecosystem, regexp_extract(line, '(example\\S+)', 1) AS name, regexp_extract(line, ' (v\\S+)', 1) AS version, manifest_path, line_no AS line FROM lines WHERE contains(line, 'example.org/')",
}
for _no, (_kind, _parse) in enumerate([(k, p) for k, p in PARSERS]):
    _name = {"package.json": "p1_package_json", "package-lock.json": "p3_package_lock", "yarn.lock": "p4_yarn_lock", "pnpm-lock.yaml": "p5_pnpm_lock", "requirements.txt": "p6_requirements", "pyproject.toml": "p7_pyproject", "pom.xml": "p8_pom", "build.gradle": "p9_gradle", "go.mod": "p10_go_mod", "app.csproj": "p11_csproj", "packages.config": "p12_packages_config"}[_kind]
    register(_name, lambda spark, d, k=_kind, p=_parse: p(manifests(spark, d, k)), f"WITH {_sql(_kind)}{' ' if _SQLS[_kind].startswith('SELECT') else ', '}{_SQLS[_kind]}")

register("p2_npm_specs", lambda spark, d: npm_spec(read(spark, d, "part").selectExpr("p_partkey", f"{_NAME} AS name", f"element_at(array('^1.2', 'npm:@a/b@~2.0', 'workspace:^3', 'git+ssh://x', '*', 'npm:c@4'), CAST(p_partkey % 6 + 1 AS INT)) AS spec")).select("p_partkey", "name", version(F.col("raw")).alias("version")), f"SELECT p_partkey, CASE k WHEN 1 THEN '@a/b' WHEN 5 THEN 'c' ELSE n END AS name, ['1.2', '2.0', '3', '', '', '4'][k::INT + 1] AS version FROM (SELECT p_partkey, p_partkey % 6 AS k, {_NAME} AS n FROM part) WHERE k NOT IN (3, 4)")
_EACH = " UNION ALL ".join(f"SELECT * FROM (WITH {_sql(k)}{' ' if _SQLS[k].startswith('SELECT') else ', '}{_SQLS[k]})" for k, _ in PARSERS)
register("p13_collect", lambda spark, d: collect(spark, d).drop("parser"), f"WITH a AS ({_EACH}) SELECT DISTINCT ecosystem, name, version, manifest_path, line FROM a QUALIFY row_number() OVER (PARTITION BY ecosystem, lower(name), version, manifest_path ORDER BY line) = 1")
register("p14_project_gate", lambda spark, d: project_gate(all_manifests(spark, d)), "WITH m AS (SELECT p_partkey, ['package.json', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'requirements.txt', 'build.gradle', 'go.mod', 'pom.xml', 'app.csproj', 'packages.config', 'pyproject.toml'][(p_partkey % 11)::INT + 1] AS f FROM part) SELECT 'r' || p_partkey AS repo, f = 'package.json' AS node, f IN ('requirements.txt', 'pyproject.toml') OR p_partkey % 33 = 3 AS python FROM m")
register("p15_cap_with_notice", lambda spark, d: _capped(spark, d), f"WITH d AS (SELECT p_partkey AS ordinal, {_NAME} AS name FROM part), c AS (SELECT count(*) AS n FROM d) (SELECT ordinal, name, 'dependency' AS kind FROM d ORDER BY ordinal LIMIT 200) UNION ALL SELECT NULL, 'truncated to 200 of ' || n, 'notice' FROM c WHERE n > 200")
_ECO = "CASE lower(trim(e)) WHEN 'npm' THEN 'npm' WHEN 'pypi' THEN 'PyPI' WHEN 'maven' THEN 'Maven' WHEN 'go' THEN 'Go' WHEN 'nuget' THEN 'NuGet' ELSE coalesce(nullif(trim(e), ''), 'npm') END"
register("p16_ecosystem", lambda spark, d: read(spark, d, "part").selectExpr("p_partkey", "element_at(array(' NPM', 'pypi', 'MAVEN ', 'go', 'NuGet', '', 'cargo'), CAST(p_partkey % 7 + 1 AS INT)) AS e").selectExpr("p_partkey", f"{_ECO} AS ecosystem"), f"SELECT p_partkey, {_ECO} AS ecosystem FROM (SELECT p_partkey, [' NPM', 'pypi', 'MAVEN ', 'go', 'NuGet', '', 'cargo'][(p_partkey % 7)::INT + 1] AS e FROM part)")


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 in order, and a notice row when there are more: the cap is the operator."""
    d = read(spark, sf_dir, "part").selectExpr("p_partkey AS ordinal", f"{_NAME} AS name")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    notice = n.where("n > 200").selectExpr("CAST(NULL AS BIGINT) AS ordinal", "'truncated to 200 of ' || n AS name", "'notice' AS kind")
    return d.orderBy("ordinal").limit(200).withColumn("kind", F.lit("dependency")).unionByName(notice)


