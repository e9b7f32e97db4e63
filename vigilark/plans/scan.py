"""A scan of a source tree: files, matches, findings, data flow, one finding a place, and their places in the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.classify import EMITTED, finalize, where_computed
from ..operators.context import with_context
from ..operators.report import cross_scanner_dedup, merge_duplicates, ranked
from ..operators.rule_index import file_matches
from ..operators.rules import rule_rows, valid
from ..operators.taint import taint_flows
from ..sources.readers import external_rules, source_files


def all_rules(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """The built-in rules as rows, and after them those of a folder of JSON files in the order of their ids."""
    own = rule_rows(spark)
    if not folder:
        return own
    more = external_rules(spark, folder).select((F.lit(own.count()) + F.row_number().over(W.orderBy("id", "pattern")) - 1).cast("int").alias("rule_no"), F.col("id").alias("rule_id"), F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), "pattern")
    return own.unionByName(more)


def scan_files(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """files (file_path, text) to findings with category, severity, confidence, reach, count and place in the report; rules as all_rules gives them."""
    rules = all_rules(files.sparkSession) if rules is None else rules
    found = valid(file_matches(files.select("file_path", "text"), rules))
    # the order of a report: files by name, rules and matches in theirs
    place = F.struct("file_path", "rule_no", "nth")
    x = finalize(found.select(
        place.alias("ordinal"), F.lit("").alias("repo"), "nth", "rule_no", "file_path", "line_no", "rule_id", F.lit("").alias("title"), F.lit("").alias("message"),
        F.col("text").alias("snippet"), F.lit("regex").alias("scanner"), F.col("severity").alias("scanner_severity"),
    ))
    x = where_computed(x, EMITTED).withColumns({
        "file": F.col("file_path"), "line": F.col("line_no"), "finding_type": F.lit("code"), "package": F.lit(None).cast("string"), "cve": F.lit(None).cast("string"),
        "exploitability_level": F.lit(""),
    })
    flows = taint_flows(files.select("file_path", "text")).withColumnsRenamed({"file_path": "flow_file", "line": "flow_line"})
    y = with_context(x, flows).drop("flow_file", "kind", "best", "all_sanitized", "n_flows", "want", "sanitized", "uncertain", "tier", "severity", "confidence", "confidence_label", "data_source", "usage_context", "exploitability_level")
    y = y.withColumnsRenamed({"new_severity": "severity", "new_confidence": "confidence", "new_label": "confidence_label", "new_data_source": "data_source", "new_usage_context": "usage_context", "new_exploitability_level": "exploitability_level"})
    y = y.withColumn("title", F.concat(F.lit("["), "severity", F.lit("] "), "category"))
    return ranked(merge_duplicates(cross_scanner_dedup(y))).select(
        "place", "file", "line", "rule_id", "category", "title", "severity", "confidence", "confidence_label", "attention_level", "evidence", "data_source", "usage_context",
        "exploitability", "exploitability_level", F.col("route").alias("route_hint"), F.col("source").alias("source_symbol"), F.col("sink").alias("sink_symbol"), "depth", "chain", "framework", "occurrence_count",
    )


def scan(spark: SparkSession, root: str, rule_folder: str | None = None) -> DataFrame:
    """The report of the files below root, by the built-in rules and those of rule_folder."""
    return scan_files(source_files(spark, root), all_rules(spark, rule_folder))
