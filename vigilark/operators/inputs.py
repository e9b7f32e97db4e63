"""Reports, rule files, items and manifests as JSON texts made from the tables, parsed by the readers' own steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register
from ..sources import readers
from ..sources.fixtures import FINDINGS, read

_K = "o_orderkey"


def hmac_sha256(key: str, message: Column) -> Column:
    """The keyed digest in hex, for keys of at most 64 bytes."""
    padded = key.encode().ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in padded).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))), 256)


def parsed(df: DataFrame, text: str, schema: str, corrupt: bool = False) -> DataFrame:
    """The fields of a JSON text built by an SQL expression; what doesn't parse is kept aside in _corrupt_record."""
    options = {"mode": "PERMISSIVE", **({"columnNameOfCorruptRecord": "_corrupt_record"} if corrupt else {})}
    return df.select(F.from_json(F.expr(text), schema, options).alias("d")).select("d.*")


# names that look like noise or are it: contest.py and transcript.py aren't
_PATH = f"CASE {_K} % 5 WHEN 0 THEN 'a/tests/x' WHEN 1 THEN 'src/contest' WHEN 2 THEN 'a/data/x' WHEN 3 THEN 'src/transcript' ELSE 'src/spec_demo' END || {_K}"
_SEM = f"'{{\"results\":[{{\"check_id\":\"c' || {_K} || '\",\"path\":\"a' || {_K} || CASE {_K} % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.py' ELSE '.ts' END || '\",\"start\":{{\"line\":' || ({_K} % 9 + 1) || '}},\"extra\":{{\"severity\":\"' || CASE {_K} % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END || '\"}}}}]}}'"
_BAN = f"'{{\"results\":[{{\"test_id\":\"' || CASE {_K} % 3 WHEN 0 THEN 'B101' WHEN 1 THEN 'B311' ELSE 'B602' END || '\",\"filename\":\"' || {_PATH} || '.py\",\"line_number\":' || ({_K} % 9 + 1) || ',\"issue_severity\":\"' || CASE {_K} % 4 WHEN 0 THEN 'HIGH' ELSE 'low' END || '\"}}]}}'"
_RUL = f"CASE WHEN {_K} % 5 = 0 THEN '{{ broken' ELSE '{{\"id\":\"r' || {_K} || '\",\"name\":\"n\",\"pattern\":\"x\",\"severity\":\"high\",\"description\":\"d\"}}' END"
_FEE = f"CASE WHEN {_K} % 6 = 0 THEN '[1' ELSE '{{\"feedback_id\":\"' || {_K} || '\",\"email\":\"a\",\"rating\":' || ({_K} % 8) || '}}' END"
_MAN = f"'{{\"repos\":[{{\"id\":\"' || {_K} || '\",\"path\":\"' || CASE {_K} % 4 WHEN 0 THEN '../x' WHEN 1 THEN '/etc' ELSE 'r/x' END || '\"}}]}}'"
_o = lambda s, d: read(s, d, "orders")

register("s11_semgrep_report", lambda s, d: readers.semgrep_findings(parsed(_o(s, d), _SEM, readers.SEMGREP)).select("rule_id", "file_path", "line", "severity"), f"SELECT 'c' || {_K} AS rule_id, 'a' || {_K} || CASE {_K} % 3 WHEN 0 THEN '.js' ELSE '.ts' END AS file_path, ({_K} % 9 + 1)::INT AS line, CASE {_K} % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM orders WHERE {_K} % 3 <> 1")
register("s12_bandit_report", lambda s, d: readers.bandit_findings(parsed(_o(s, d), _BAN, readers.BANDIT)).select("rule_id", "file_path", "line", "severity"), f"SELECT CASE {_K} % 3 WHEN 0 THEN 'bandit.b101' WHEN 1 THEN 'bandit.b311' ELSE 'bandit.b602' END AS rule_id, {_PATH} || '.py' AS file_path, ({_K} % 9 + 1)::INT AS line, CASE {_K} % 4 WHEN 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM orders WHERE {_K} % 3 = 2 OR {_K} % 5 NOT IN (0, 2)")
register("f12_noise_filter", lambda s, d: readers.bandit_findings(parsed(_o(s, d), _BAN, readers.BANDIT)).groupBy("rule_id").count().withColumnRenamed("count", "n"), f"SELECT CASE {_K} % 3 WHEN 0 THEN 'bandit.b101' WHEN 1 THEN 'bandit.b311' ELSE 'bandit.b602' END AS rule_id, count(*) AS n FROM orders WHERE {_K} % 3 = 2 OR {_K} % 5 NOT IN (0, 2) GROUP BY 1")
register("s7_rule_files", lambda s, d: readers.usable_rules(parsed(_o(s, d), _RUL, readers.RULE, True)).select("id", "severity"), f"SELECT 'r' || {_K} AS id, 'HIGH' AS severity FROM orders WHERE {_K} % 5 <> 0")
register("s14_items_with_bad_rows", lambda s, d: readers.usable_items(parsed(_o(s, d), _FEE, readers.FEEDBACK, True)).select("feedback_id", "rating"), f"SELECT {_K}::VARCHAR AS feedback_id, ({_K} % 8)::INT AS rating FROM orders WHERE {_K} % 6 <> 0 AND {_K} % 8 BETWEEN 1 AND 5")
register("s15_manifest_repos", lambda s, d: readers.usable_repos(parsed(_o(s, d), _MAN, readers.MANIFEST)).select("id", "path"), f"SELECT {_K}::VARCHAR AS id, 'r/x' AS path FROM orders WHERE {_K} % 4 >= 2")
register("x12_digests", lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")), "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
register("x12_hmac", lambda s, d: _o(s, d).select("o_orderkey", hmac_sha256("k3y", F.col("o_orderpriority")).alias("signature")), "WITH p AS (SELECT o_orderkey, sha256((SELECT string_agg(chr(xor(CASE WHEN i < 3 THEN ascii(('k3y')[i::INT + 1]) ELSE 0 END, 54)), '' ORDER BY i) FROM range(64) t(i)) || o_orderpriority) AS inner_hex FROM orders) SELECT o_orderkey, sha256(encode((SELECT string_agg(chr(xor(CASE WHEN i < 3 THEN ascii(('k3y')[i::INT + 1]) ELSE 0 END, 92)), '' ORDER BY i) FROM range(64) t(i))) || unhex(inner_hex)) AS signature FROM p")
_TOML = "'a = ' || o_orderkey || chr(10) || '[t]' || chr(10) || 'b = ' || chr(34) || 'x' || (o_orderkey % 9) || chr(34) || CASE WHEN o_orderkey % 8 = 0 THEN '= broken' ELSE '' END"


@F.udtf(returnType="a long, b string")
class TomlFields:
    """Two fields of a TOML text; none if it isn't one."""

    def eval(self, text: str):
        import tomllib

        try:
            d = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return
        yield d.get("a"), (d.get("t") or {}).get("b")


register("x10_toml", lambda s, d: _o(s, d).select("o_orderkey", F.expr(_TOML).alias("text")).lateralJoin(TomlFields(F.col("text").outer())).select("o_orderkey", "a", "b"), "SELECT o_orderkey, o_orderkey AS a, 'x' || (o_orderkey % 9) AS b FROM orders WHERE o_orderkey % 8 <> 0")


def normal_path(path: Column, root: str) -> Column:
    """A finding's path below the repository: relative to root, after the last /repo/, or without leading dots and slashes."""
    raw = F.trim(F.coalesce(path, F.lit("")))
    below = F.when(F.startswith(raw, F.lit(root.rstrip("/") + "/")), F.substr(raw, F.lit(len(root.rstrip("/")) + 2)))
    slashed = F.replace(raw, F.lit(chr(92)), F.lit("/"))
    tail = F.regexp_extract(slashed, r"(?is)^.*/repo/(.+)$", 1)
    after = F.when(tail != "", F.regexp_replace(tail, r"^/+", ""))
    # a set of characters goes, so that .env becomes env
    bare = F.nullif(F.regexp_replace(slashed, r"^[./]+", ""), F.lit(""))
    return F.when(raw == "", "unknown").otherwise(F.coalesce(below, after, bare, F.lit("unknown")))


_RAW = ["/work/r/src/a.py", "/tmp/x/Repo/lib/b.js", ".env", "./src/c.ts", "C:\\\\x\\\\repo\\\\d.go", " ", "../e.py", "/repo/", "/tmp/repo/k/repo//f.py"]
_RAW = [x.replace("\\\\", chr(92)) for x in _RAW]
_NORMAL = ["src/a.py", "lib/b.js", "env", "src/c.ts", "d.go", "unknown", "e.py", "repo/", "f.py"]
register("f17_normal_path", lambda s, d: _o(s, d).select("o_orderkey", normal_path(F.element_at(F.array(*[F.lit(x) for x in _RAW]), (F.col("o_orderkey") % len(_RAW) + 1).cast("int")), "/work/r").alias("path")), f"SELECT o_orderkey, {_NORMAL}[(o_orderkey % {len(_NORMAL)})::INT + 1] AS path FROM orders")
register("x9_xml", lambda s, d: read(s, d, "part").select("p_partkey", F.xpath_string(F.format_string("<p v=\"%s\"><n>%s</n></p>", "p_size", "p_partkey"), F.lit("p/n")).alias("n"), F.xpath_int(F.format_string("<p v=\"%s\"/>", "p_size"), F.lit("p/@v")).alias("v")), "SELECT p_partkey, p_partkey::VARCHAR AS n, p_size AS v FROM part")
# addresses of pages as paths of findings: below the root, after the last /repo/, or bare; the expected ones by the parts of the address
_AS_PATH = "CASE page_id % 4 WHEN 0 THEN concat('/work/r', p, '.py') WHEN 1 THEN concat('/tmp/k/Repo', p, '.js') WHEN 2 THEN concat('..', p) ELSE replace(p, '/', chr(92)) END"
register("f17_page_paths", lambda s, d: read(s, d, "pages").select("page_id", F.parse_url("url", F.lit("PATH")).alias("p")).select("page_id", normal_path(F.expr(_AS_PATH), "/work/r").alias("path")), "WITH x AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) AS p FROM pages) SELECT page_id, CASE page_id % 4 WHEN 0 THEN p || '.py' WHEN 1 THEN p || '.js' ELSE p END AS path FROM x")
