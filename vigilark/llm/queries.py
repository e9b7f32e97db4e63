"""The queries of the corpus operators, one op<N>_<name> each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fim, html, langid, mixing, ngram, pipeline, quality, resample, simhash, substrings, tokens, warc
from .common import table


def _over(name: str, fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": _over("documents", mixing.op1),
        "op2_quality": _over("documents", quality.judge),
        "op3_simhash": _over("documents", simhash.op3),
        "op4_decontam": lambda spark, sf_dir: decontam.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op5_chat": _over("conversations", chat.op5),
        "op6_langid": _over("documents", langid.op6),
        "op7_lm": _over("documents", ngram.op7),
        "op8_html": _over("pages", html.op8),
        "op9_tokens": _over("documents", tokens.op9),
        "op10_warc": _over("pages", warc.op10),
        "op11_resample": lambda spark, sf_dir: resample.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op12_fim": _over("documents", fim.op12),
        "op13_substrings": _over("documents", substrings.op13),
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op2_quality": quality.OP2_SQL, "op5_chat": chat.OP5_SQL, "op10_warc": warc.OP10_SQL, "op11_resample": resample.OP11_SQL, "op12_fim": fim.OP12_SQL, "op13_substrings": substrings.OP13_SQL}
