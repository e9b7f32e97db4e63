"""Readers and sinks: source trees, rule files, analyzer reports, item files with bad rows, exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has
from ..operators.rules import MAX_FILE_BYTES, SCANNED_PARTS

RULE = "id string, name string, language string, pattern string, severity string, description string, fix string, _corrupt_record string"
SEMGREP = "results array<struct<check_id:string,path:string,start:struct<line:int>,severity:string,message:string,extra:struct<lines:string,severity:string,message:string>>>"
BANDIT = "results array<struct<test_id:string,filename:string,line_number:int,severity:string,issue_severity:string,issue_text:string,code:string>>"
FEEDBACK = "feedback_id string, email string, scan_id string, rating int, category string, comment string, issue_id string, created_at timestamp, _corrupt_record string"
MANIFEST = "repos array<struct<id:string,path:string,expected_issue_count:int,issue_tolerance:int,expected_high_count:int,high_tolerance:int>>"


def source_files(spark: SparkSession, root: str, where: str = SCANNED_PARTS, undecodable: str = "replace") -> DataFrame:
    """(file_path, text, n_bytes) below root: size and name are tested before a file's content is decoded.

    Bytes that aren't UTF-8 become replacement characters, or with undecodable="ignore" leave the text; the replacement
    character itself stays where the file has it. A file without any has no row. where is the condition on file_path, that of a scan by rules if not told.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_literal(root))
    # paths of files are told as they are, not as addresses, so the folder's own name is looked for as it is
    folder = root.rstrip("/").split("://")[-1] + "/"
    named = raw.withColumn("file_path", F.substr("path", F.instr("path", folder) + len(folder)))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    if undecodable == "ignore":
        kept = F.lit("\ufffd")
        mark = F.lit("\x00\x01\x00")  # stands for the replacement characters that the file has itself
        text = F.replace(F.replace(F.make_valid_utf8(F.replace(F.col("content").cast("string"), kept, mark)), kept, F.lit("")), mark, kept)
    return named.where(F.col("length") <= MAX_FILE_BYTES).where(F.expr(where)).select("file_path", text.alias("text"), F.col("length").alias("n_bytes"))


def _literal(path: str) -> str:
    """A folder's name with the characters escaped that a path pattern would read."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def external_rules(spark: SparkSession, folder: str) -> DataFrame:
    return usable_rules(spark.read.schema(RULE).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder))


def usable_rules(x: DataFrame) -> DataFrame:
    """Rules of parsed files, one a file; a file that isn't a rule is left out."""
    return x.where("_corrupt_record IS NULL AND id IS NOT NULL AND pattern IS NOT NULL").select("id", "name", "pattern", F.upper("severity").alias("severity"), F.col("description").alias("message"))


def semgrep_report(spark: SparkSession, path: str) -> DataFrame:
    return semgrep_findings(spark.read.schema(SEMGREP).option("multiLine", True).json(path))


def semgrep_findings(report: DataFrame) -> DataFrame:
    """Findings of parsed reports; severity and message are read at either level."""
    r = report.select(F.explode("results").alias("r"))
    level = F.upper(F.trim(F.coalesce("r.severity", "r.extra.severity", F.lit(""))))
    return r.select(F.col("r.check_id").alias("rule_id"), F.col("r.path").alias("file_path"), F.coalesce("r.start.line", F.lit(1)).alias("line"), F.when(level.isin("ERROR", "HIGH"), "HIGH").when(level.isin("WARNING", "MEDIUM"), "MEDIUM").otherwise("LOW").alias("severity"), F.coalesce("r.message", "r.extra.message").alias("message"), F.col("r.extra.lines").alias("snippet")).where(F.rlike("file_path", F.lit(r"\.(js|jsx|ts|tsx|mjs|cjs)$")))


NOISE_RULES = ("B101", "B311", "B322", "B330")
NOISE_NAMES = ("/tests/", "/test/", "test_", "_test", "conftest", "/fixtures/", "fixture", "/data/", "/scripts/", "generate", "dataset", "seed", "mock", "sample", "factory")


def bandit_report(spark: SparkSession, path: str) -> DataFrame:
    return bandit_findings(spark.read.schema(BANDIT).option("multiLine", True).json(path))


def bandit_findings(report: DataFrame) -> DataFrame:
    """Findings of parsed reports, without the noisy rules in files that aren't production code."""
    r = report.select(F.explode("results").alias("r"))
    level = F.upper(F.trim(F.coalesce("r.severity", "r.issue_severity", F.lit(""))))
    noise = F.col("r.test_id").isin(*NOISE_RULES) & F.expr(has("replace(lower(r.filename), chr(92), '/')", NOISE_NAMES))
    return r.where(~noise).select(F.concat(F.lit("bandit."), F.lower("r.test_id")).alias("rule_id"), F.col("r.filename").alias("file_path"), F.col("r.line_number").alias("line"), F.when(level.isin("HIGH", "MEDIUM"), level).otherwise("LOW").alias("severity"), F.col("r.issue_text").alias("message"), F.col("r.code").alias("snippet"))


def feedback_items(spark: SparkSession, path: str) -> DataFrame:
    return usable_items(spark.read.schema(FEEDBACK).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def usable_items(x: DataFrame) -> DataFrame:
    """Items of a JSON array; rows that break a rule of the schema are left out, the others stay."""
    return x.where("_corrupt_record IS NULL AND rating BETWEEN 1 AND 5 AND email IS NOT NULL").drop("_corrupt_record")


def validation_manifest(spark: SparkSession, path: str) -> DataFrame:
    return usable_repos(spark.read.schema(MANIFEST).option("multiLine", True).json(path))


def usable_repos(manifest: DataFrame) -> DataFrame:
    """Repositories of parsed manifests; paths that leave the folder are left out."""
    r = manifest.select(F.explode("repos").alias("r")).select("r.*")
    return r.where(F.col("path").isNotNull() & ~F.rlike("path", F.lit(r"(^/|(^|/)\.\.(/|$))")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def json_report(findings: DataFrame, *keys: str) -> DataFrame:
    """One JSON text a scan: its findings in order, nested."""
    rest = [c for c in findings.columns if c not in keys]
    return findings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in rest if c != "ordinal"]))).alias("issues")).select(*keys, F.to_json(F.struct("issues")).alias("report"))
