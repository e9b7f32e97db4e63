"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a new folder of this machine, for a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vigilark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with_count(df: DataFrame, name: str, which: Column) -> tuple[DataFrame, int]:
    """The same, and how many of its rows meet a condition, counted by the job that writes them."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(which).alias("n")), name)
    return out, seen.get["n"]


def once_a_text(files: DataFrame, suffix: Column, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What found tells of files (file_path, text), where that follows from a file's text and suffix: read once a text, told of each file.

    Files whose suffix is null have nothing. found gets files that are named by their text's digest and the suffix.
    """
    named = files.select("file_path", suffix.alias("_suffix"), "text").where("_suffix IS NOT NULL AND text IS NOT NULL")
    of = F.concat(F.sha2("text", 256), "_suffix")
    # stored on both sides, so that what reads the texts several times finds them made, and the join knows how little is told
    told = stored(found(stored(named.select("_suffix", "text").distinct().select(of.alias("file_path"), "text"), "texts")), "told")
    back = named.select("file_path", of.alias("_of")).join(told.withColumnRenamed("file_path", "_of"), "_of")
    return back.select(*told.columns)
