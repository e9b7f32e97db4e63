"""Findings joined to data-flow facts: best flow, anti join, all-sanitized branch, band join, confidence boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cases, has
from ..registry import register
from ..sources.fixtures import CODE_LINES, FINDINGS, FLOWS, findings, flows
from .classify import LABEL, SINK_HINTS, cap
from .taint import LANGUAGE, STRINGS, clean, sink_calls

KIND = cases([(f"contains(lower(category), '{c}')", f"'{c.replace(' ', '_')}'") for c in ("sql injection", "command injection", "open redirect")], "NULL")
TIER_RANK = "CASE upper(tier) WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
TIER = "CASE WHEN sanitized THEN 'LOW' WHEN uncertain OR depth > 0 THEN 'MEDIUM' WHEN kind IN ('sql_injection', 'command_injection') THEN 'HIGH' ELSE 'MEDIUM' END"
BOOST = (
    "greatest(0, least(CASE upper(tier) WHEN 'HIGH' THEN 92 WHEN 'MEDIUM' THEN 84 ELSE 72 END, confidence + greatest(0, "
    "CASE WHEN sanitized THEN 0 WHEN upper(tier) = 'HIGH' THEN 16 WHEN upper(tier) = 'MEDIUM' THEN 9 ELSE 3 END - least(depth, 2) * 3 - CASE WHEN uncertain THEN 2 ELSE 0 END - CASE WHEN uncertain AND depth >= 2 THEN 2 ELSE 0 END - CASE WHEN sanitized THEN 5 ELSE 0 END)))"
)
LIMIT = "CASE upper(tier) WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END"


#: What a finding takes over from the best flow, with the types of what flows may lack.
BEST = {"flow_line": "int", "sanitized": "boolean", "depth": "int", "uncertain": "boolean", "tier": "string", "route": "string", "source": "string", "sink": "string", "chain": "array<string>", "framework": "string"}


def best_flows(fl: DataFrame) -> DataFrame:
    """One row a (file, kind): whether all flows are sanitized, and the best unsafe one.

    The best flow doesn't depend on the finding, so flows are reduced before the join and each finding meets one row.
    """
    order = F.struct(-F.expr(TIER_RANK), "depth", F.col("uncertain").cast("int"), "flow_line")
    told = [F.col(c) if c in fl.columns else F.lit(None).cast(BEST[c]).alias(c) for c in BEST]
    unsafe = F.when(~F.col("sanitized"), F.struct(order.alias("o"), F.struct(*told).alias("f")))
    return fl.groupBy("flow_file", "kind").agg(F.min(unsafe).alias("best"), F.bool_and("sanitized").alias("all_sanitized"), F.count(F.lit(1)).alias("n_flows"))


#: Words that show a dangerous call, where no flow was found.
SHOWN = (*SINK_HINTS, "shell=true")
ATTENTION = "CASE WHEN upper({1}) IN ('HIGH', 'MEDIUM', 'LOW') THEN upper({1}) WHEN {0} >= 80 THEN 'HIGH' WHEN {0} >= 60 THEN 'MEDIUM' ELSE 'LOW' END"


def with_context(f: DataFrame, fl: DataFrame) -> DataFrame:
    """Findings after the flows of their file and kind: severity, confidence, labels, source, use and reach.

    A pattern's finding without any flow goes, unless its own words show input, a risky use and a dangerous call.
    """
    b = best_flows(fl)
    j = f.withColumn("want", F.expr(KIND)).join(b, (F.col("file") == F.col("flow_file")) & (F.col("want") == F.col("kind")), "left")
    branch = F.when(F.col("want").isNull(), "other").when(F.col("n_flows").isNull(), "no_flow").when(F.col("all_sanitized"), "sanitized").otherwise("reachable")
    j = j.withColumn("branch", branch).select("*", *[F.col(f"best.f.{c}").alias(c) for c in BEST])
    told = "concat_ws(' ', lower(evidence), lower(message))"
    shown = f"data_source = 'user_input' AND usage_context IN ('database', 'executed') AND {has(told, SHOWN)}"
    j = j.where(f"NOT (branch = 'no_flow' AND scanner = 'regex' AND NOT ({shown}))")
    severity = f"CASE branch WHEN 'other' THEN severity WHEN 'reachable' THEN {cap('severity', LIMIT)} ELSE {cap('severity', chr(39) + 'LOW' + chr(39))} END"
    confidence = f"CASE branch WHEN 'other' THEN confidence WHEN 'no_flow' THEN least(confidence, 55) WHEN 'sanitized' THEN least(confidence, 52) ELSE {BOOST} END"
    j = j.withColumn("new_severity", F.expr(severity)).withColumn("new_confidence", F.expr(confidence).cast("int"))
    met = F.col("branch").isin("sanitized", "reachable")
    use = F.when(met & (F.col("want") == "sql_injection"), "database").when(met & (F.col("want") == "command_injection"), "executed").otherwise(F.col("usage_context"))
    low = F.col("branch").isin("no_flow", "sanitized")
    attention = f"CASE branch WHEN 'sanitized' THEN 'LOW' WHEN 'reachable' THEN {ATTENTION.format('new_confidence', 'tier')} ELSE {ATTENTION.format('new_confidence', 'exploitability_level')} END"
    return j.withColumns({
        "new_data_source": F.when(met, "user_input").otherwise(F.col("data_source")), "new_usage_context": use, "new_label": F.when(low, "LOW").otherwise(F.expr(LABEL.replace("confidence", "new_confidence"))),
        "attention_level": F.expr(attention), "exploitability": F.when(F.col("branch") == "reachable", "reachable").when(low, "unknown"),
        "new_exploitability_level": F.when(F.col("branch") == "reachable", F.col("tier")).when(low, "LOW").otherwise(F.col("exploitability_level")),
    })


_JOINED = f"""u AS (SELECT *, row_number() OVER (PARTITION BY flow_file, kind ORDER BY {TIER_RANK} DESC, depth, uncertain, flow_line) AS nth FROM flows WHERE NOT sanitized),
k AS (SELECT flow_file, kind, count(*) AS n_flows FROM flows GROUP BY 1, 2), w AS (SELECT *, {KIND} AS want FROM findings),
j AS (SELECT w.*, n_flows, u.flow_line, u.sanitized, u.depth, u.uncertain, u.tier, CASE WHEN want IS NULL THEN 'other' WHEN n_flows IS NULL THEN 'no_flow' WHEN u.flow_line IS NULL THEN 'sanitized' ELSE 'reachable' END AS branch
  FROM w LEFT JOIN k ON k.flow_file = file AND k.kind = want LEFT JOIN u ON u.flow_file = file AND u.kind = want AND nth = 1
  WHERE NOT (want IS NOT NULL AND n_flows IS NULL AND scanner = 'regex' AND NOT (data_source = 'user_input' AND usage_context IN ('database', 'executed') AND regexp_matches(lower(evidence || ' ' || message), 'cursor[.]execute|select |eval[(]|exec[(]|os[.]system|subprocess|yaml[.]load|pickle[.]loads?|fromsqlraw|executesqlraw|sqlcommand|queryrow[(]|db[.](query|exec)[(]|exec[.]command|process[.]start|shell=true'))))"""


def _q(name, fn, sql):
    register(name, lambda s, d: fn(findings(s, d), flows(s, d)), f"WITH {FINDINGS}, {FLOWS}, {_JOINED} {sql}")


_q("j1_flow_join", lambda f, fl: with_context(f, fl).select("ordinal", "branch"), "SELECT ordinal, branch FROM j")
_q("j2_band_join", lambda f, fl: _band(f, fl), "SELECT ordinal, count(*) AS n FROM findings JOIN flows ON file = flow_file AND abs(line - flow_line) <= 3 GROUP BY 1")
_q("j3_no_flow", lambda f, fl: with_context(f, fl).where("branch = 'no_flow'").selectExpr("ordinal", "new_severity AS severity", "new_confidence AS confidence"), "SELECT ordinal, CASE WHEN severity = 'INFO' THEN 'INFO' ELSE 'LOW' END AS severity, if(confidence > 55, 55, confidence) AS confidence FROM j WHERE branch = 'no_flow'")
_LEVEL = "(SELECT CASE WHEN x IN ('HIGH', 'MEDIUM', 'LOW') THEN x ELSE CASE WHEN c < 60 THEN 'LOW' WHEN c < 80 THEN 'MEDIUM' ELSE 'HIGH' END END)"
_q("c9_attention_level", lambda f, fl: f.selectExpr("ordinal", f"{ATTENTION.format('confidence', 'exploitability_level')} AS attention_level"), f"SELECT ordinal, {_LEVEL} AS attention_level FROM (SELECT ordinal, exploitability_level AS x, confidence AS c FROM findings)")
_q("j1_context_columns", lambda f, fl: with_context(f, fl).select("ordinal", F.col("new_data_source").alias("data_source"), F.col("new_usage_context").alias("usage_context"), F.col("new_exploitability_level").alias("exploitability_level"), "exploitability"), """SELECT ordinal, if(branch IN ('sanitized', 'reachable'), 'user_input', data_source) AS data_source, CASE WHEN branch IN ('no_flow', 'other') OR want = 'open_redirect' THEN usage_context WHEN want = 'sql_injection' THEN 'database' ELSE 'executed' END AS usage_context,
  CASE branch WHEN 'other' THEN exploitability_level WHEN 'reachable' THEN tier ELSE 'LOW' END AS exploitability_level, CASE branch WHEN 'reachable' THEN 'reachable' WHEN 'other' THEN NULL ELSE 'unknown' END AS exploitability FROM j""")
_q("j4_best_flow", lambda f, fl: with_context(f, fl).where("branch = 'reachable'").select("ordinal", "flow_line", "depth", "uncertain", "tier"), "SELECT ordinal, flow_line, depth, uncertain, tier FROM j WHERE branch = 'reachable'")
_q("j5_all_sanitized", lambda f, fl: fl.groupBy("flow_file", "kind").agg(F.bool_and("sanitized").alias("all_sanitized")), "SELECT flow_file, kind, bool_and(sanitized) AS all_sanitized FROM flows GROUP BY 1, 2")
_q("t15_tier", lambda f, fl: fl.selectExpr("flow_file", "kind", "flow_line", "sanitized", "depth", "uncertain", "tier", f"{TIER} AS assessed"), f"SELECT flow_file, kind, flow_line, sanitized, depth, uncertain, tier, {TIER} AS assessed FROM flows")
_q("t16_boosted_confidence", lambda f, fl: with_context(f, fl).where("branch = 'reachable'").select("ordinal", "new_confidence"), f"SELECT ordinal, ({BOOST})::INT AS new_confidence FROM j WHERE branch = 'reachable'")
_q("taint_context", lambda f, fl: with_context(f, fl).select("ordinal", "branch", "new_severity", "new_confidence"), f"SELECT ordinal, branch, CASE branch WHEN 'other' THEN severity WHEN 'reachable' THEN {cap('severity', LIMIT)} ELSE {cap('severity', chr(39) + 'LOW' + chr(39))} END AS new_severity, (CASE branch WHEN 'other' THEN confidence WHEN 'no_flow' THEN least(confidence, 55) WHEN 'sanitized' THEN least(confidence, 52) ELSE {BOOST} END)::INT AS new_confidence FROM j")


def _band(f: DataFrame, fl: DataFrame) -> DataFrame:
    """Flows within three lines, counted: flows are counted by place, counts spread over the lines that they reach, and a finding looks up its own."""
    places = fl.groupBy("flow_file", "flow_line").agg(F.count(F.lit(1)).alias("k"))
    reach = places.select("flow_file", F.explode(F.sequence(F.col("flow_line") - 3, F.col("flow_line") + 3)).alias("at"), "k").groupBy("flow_file", "at").agg(F.sum("k").alias("n"))
    return f.join(reach, (F.col("file") == F.col("flow_file")) & (F.col("line") == F.col("at"))).select("ordinal", "n")


def _code(name, fn, sql):
    from ..sources.fixtures import code_lines

    register(name, lambda s, d: fn(code_lines(s, d)), f"WITH {CODE_LINES} {sql}")


def direct_flows(x: DataFrame) -> DataFrame:
    """Depth 0: input right inside a sink's arguments."""
    each = x.select("ordinal", F.explode(sink_calls(F.col("text"), F.expr(LANGUAGE))).alias("s"))
    return each.where("s.source IS NOT NULL").select("ordinal", "s.kind", F.col("s.symbol").alias("sink"), "s.source", F.col("s.clean").alias("sanitized"))


_quote = lambda p: "'" + p.replace("'", "''") + "'"
_T12 = r""", a AS (SELECT ordinal, text, kind, sink, rest FROM code_lines, LATERAL (VALUES
  ('js', 'sql_injection', regexp_extract(text, '(?i)(^|\W)(db|pool|connection|sequelize)[.]query\s*[(]', 2), regexp_extract(text, '(?i)[.]query\s*[(](.+)[)]', 1)),
  ('js', 'command_injection', regexp_extract(text, '(?i)(^|\W)(exec|execSync|spawn|spawnSync)\s*[(]', 2), regexp_extract(text, '(?i)(exec|spawn)(sync)?\s*[(](.+)[)]', 3)),
  ('js', 'open_redirect', regexp_extract(text, '(?i)(^|\W)(res[.]redirect|redirect)\s*[(]', 2), regexp_extract(text, '(?i)redirect\s*[(](.+)[)]', 1)),
  ('go', 'command_injection', CASE WHEN contains(text, 'exec.Command(') THEN 'exec.Command' ELSE '' END, regexp_extract(text, 'exec[.]Command[(](.+)[)]', 1))) t(lang, kind, sink, rest)
  WHERE sink <> '' AND lang = CASE WHEN regexp_matches(lower(file_path), '[.](js|jsx|ts|tsx)$') THEN 'js' WHEN ends_with(file_path, '.go') THEN 'go' END),
b AS (SELECT *, regexp_extract(rest, '(?i)req[.](query|body|params|headers|cookies)[.]([a-z0-9_]+)', 0) AS dotted, regexp_extract(rest, '(?i)req[.](query|body|params|headers|cookies)[[][''"]([^''"]+)', 2) AS named, regexp_extract(rest, 'Get[(].([a-z]+)', 1) AS got FROM a)
SELECT ordinal, kind, sink, CASE WHEN got <> '' THEN 'r.query[' || got || ']' WHEN dotted <> '' THEN dotted ELSE 'req.query[' || named || ']' END AS source, regexp_matches(rest, '[A-Za-z_$][A-Za-z0-9_$]*[[]req[.]') AS sanitized FROM b WHERE dotted || named || got <> ''"""
_code("t12_direct_sinks", direct_flows, _T12)
_code("t14_sanitizer", lambda x: x.select("ordinal", F.expr("CASE ordinal % 3 WHEN 0 THEN 'escape(' || text || ')' ELSE text END").alias("t")).select("ordinal", clean(F.col("t")).alias("sanitized")), r"""SELECT ordinal, regexp_matches(text, '(?i)[a-z0-9_$][[]\s*(req|request|ctx|context)([^a-z0-9_][^]]*)?[]]|[.](get|has|includes|find|indexof)\s*[(]\s*(req|request|ctx|context)([^a-z0-9_]|$)') OR (ordinal % 3 = 0 OR contains(lower(text), 'escape(')) AND NOT (contains(text, '+') AND regexp_matches(text, '(?i)req[.](query|body|params|headers|cookies)([.][a-z0-9_]|[[][''"])')) AS sanitized FROM code_lines""")
_code("x3_strip_strings", lambda x: x.select("ordinal", F.regexp_replace("text", STRINGS, "").alias("bare")), f"SELECT ordinal, regexp_replace(text, {_quote(STRINGS)}, '', 'g') AS bare FROM code_lines")


def fixed_text(text: Column, snippet: Column, replacement: Column) -> Column:
    """text with the first snippet in it replaced; null where any is empty, the snippet isn't there or nothing would change."""
    old, new = (F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+\z", "") for c in (snippet, replacement))
    at = F.instr(text, old)
    return F.when((text != "") & (old != "") & (new != "") & (at > 0) & (old != new), F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old))))


_OLD = "CASE ordinal % 4 WHEN 0 THEN ' req.query ' WHEN 1 THEN 'a' WHEN 2 THEN ' ' END"
_code(
    "t17_apply_fix",
    lambda x: x.select("ordinal", fixed_text(F.col("text"), F.expr(_OLD), F.expr("CASE WHEN ordinal % 5 = 0 THEN 'a' ELSE ' safe' END")).alias("fixed")),
    """SELECT ordinal, CASE WHEN ordinal % 4 = 0 AND contains(text, 'req.query') THEN regexp_replace(text, 'req[.]query', if(ordinal % 5 = 0, 'a', 'safe'))
  WHEN ordinal % 4 = 1 AND ordinal % 5 > 0 AND contains(text, 'a') THEN regexp_replace(text, 'a', 'safe') END AS fixed FROM code_lines""",
)


def _windowed(x: DataFrame) -> DataFrame:
    """Up to five lines on either side of each line, joined."""
    w = W.partitionBy("repo", "file_path").orderBy("line_no").rowsBetween(-5, 5)
    return x.select("ordinal", F.array_join(F.collect_list("text").over(w), "\n").alias("around"))


_code("t18_context_window", _windowed, "SELECT ordinal, string_agg(text, chr(10)) OVER (PARTITION BY repo, file_path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS around FROM code_lines")
# fixed values: patterns of manifests, and beginnings of source lines
MANIFEST_FRAMEWORKS = {
    "express": r"""(^|["'\s])express(["'@\s=<>~^]|$)""", "nestjs": r"@nestjs/", "fastify": r"""(^|["'\s])fastify(["'@\s=<>~^]|$)""", "koa": r"""(^|["'\s])koa(["'@\s=<>~^]|$)""", "hapi": r"@hapi/", "nextjs": r"""(^|["'\s])next(["'@\s=<>~^]|$)""",
    "django": r"(?im)^\s*django\b", "flask": r"(?im)^\s*flask\b", "fastapi": r"(?im)^\s*fastapi\b", "starlette": r"(?im)^\s*starlette\b", "sanic": r"(?im)^\s*sanic\b", "tornado": r"(?im)^\s*tornado\b", "falcon": r"(?im)^\s*falcon\b", "pyramid": r"(?im)^\s*pyramid\b",
}
SOURCE_FRAMEWORKS = {
    "from flask import": "flask", "import flask": "flask", "from django": "django", "import django": "django", "from fastapi import": "fastapi", "import fastapi": "fastapi", "from starlette": "starlette",
    "from sanic": "sanic", "import tornado": "tornado", "import falcon": "falcon", "from pyramid": "pyramid", "from nestjs": "nestjs", "@nestjs/": "nestjs", "from 'express'": "express", 'from "express"': "express",
    "require('express')": "express", 'require("express")': "express", "from 'koa'": "koa", 'from "koa"': "koa", "from 'fastify'": "fastify", 'from "fastify"': "fastify",
}
ALIASES = {"node": "express", "javascript": "express", "py": "python"}


def manifest_frameworks(text: Column) -> Column:
    """Frameworks that a manifest names, in order."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(p)), n) for n, p in MANIFEST_FRAMEWORKS.items()])))


def source_frameworks(text: Column) -> Column:
    """Frameworks that lines of a source begin with, in order."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.rlike(F.lower(text), F.lit(r"(?m)^\s*\Q" + t + r"\E")), n) for t, n in SOURCE_FRAMEWORKS.items()]))))


def framework_name(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[low], low)


# texts that hold a framework's name in each way, and look-alikes; a row takes one by its number
_NAMED = ["import flask", "  from fastapi import x", "x = 1\n from django.db import y", "const e = require('express')", "require(\"express\")", "import koa from 'koa'", "@nestjs/common", "# import flask", "from starlette.x import z", "import tornadox"]
_FOUND = ["flask", "fastapi", "django", "", "express", "", "nestjs", "", "starlette", "tornado"]
_LISTED = ['{"express": "4"}', "flask==1.0", "a\nDjango>=2", "expressive", '"@hapi/x": 1', "fastify", "myflask", "next 13"]
_LISTED_FOUND = ["express", "flask", "django", "", "hapi", "fastify", "", "nextjs"]
_list = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
_duck = lambda xs, i: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + f"][({i})::INT + 1]"
_code("c33_source_frameworks", lambda x: x.select("ordinal", F.concat_ws(",", source_frameworks(_list(_NAMED, F.col("ordinal") % len(_NAMED)))).alias("frameworks")), f"SELECT ordinal, {_duck(_FOUND, f'ordinal % {len(_FOUND)}')} AS frameworks FROM code_lines")
_code("c33_manifest_frameworks", lambda x: x.select("ordinal", F.concat_ws(",", manifest_frameworks(_list(_LISTED, F.col("ordinal") % len(_LISTED)))).alias("frameworks")), f"SELECT ordinal, {_duck(_LISTED_FOUND, f'ordinal % {len(_LISTED_FOUND)}')} AS frameworks FROM code_lines")
_code("c33_framework_names", lambda x: x.select("ordinal", framework_name(_list([" Node", "javascript", "PY", "Flask", ""], F.col("ordinal") % 5)).alias("name")), f"SELECT ordinal, {_duck(['express', 'express', 'python', 'flask', ''], 'ordinal % 5')} AS name FROM code_lines")
_code("c33_frameworks", lambda x: x.select("repo", F.explode(source_frameworks(_list(_NAMED, F.col("ordinal") % len(_NAMED)))).alias("f")).groupBy("repo").agg(F.concat_ws(",", F.array_sort(F.collect_set("f"))).alias("frameworks")), f"SELECT repo, string_agg(DISTINCT f, ',' ORDER BY f) AS frameworks FROM (SELECT repo, {_duck(_FOUND, f'ordinal % {len(_FOUND)}')} AS f FROM code_lines) WHERE f <> '' GROUP BY 1")
_code("s5_framework_scan", lambda x: x.select("repo", "file_path").distinct().withColumn("nth", F.row_number().over(W.partitionBy("repo").orderBy("file_path"))).where("nth <= 200"), "SELECT repo, file_path, row_number() OVER (PARTITION BY repo ORDER BY file_path) AS nth FROM (SELECT DISTINCT repo, file_path FROM code_lines) QUALIFY nth <= 200")
