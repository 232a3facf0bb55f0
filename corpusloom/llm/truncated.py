"""Problem 10: texts cut off by field limits.

Values (texts and their sentences, masked) are sorted and compared with their
successor: an unfinished one that is a strict prefix of a longer value elsewhere is
cut off. Where no longer copy exists, counts of the last phrase decide, and lengths
that a source has far too often mark its field limit (see
:mod:`corpusloom.llm.endings`, which also says how each step is weighed).

Defined results: null, empty and blank texts are no case; a null source is a
source of its own; copies of a text count as one text and are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.endings import with_verdict
from corpusloom.session import spread, table


def truncated(texts: DataFrame, key: str, by: str) -> DataFrame:
    """key, by, truncated: one row per row of ``texts`` (key, text, channel, by)."""
    short = F.lower(F.trim(F.coalesce(F.col("channel"), F.lit("")))).isin("sms", "text", "text message")
    rows = texts.select(key, "text", F.coalesce(F.col(by), F.lit("(none)")).alias(by), F.when(short, "s").otherwise("e").alias("grp"))
    return with_verdict(rows, by).select(key, by, F.col("unfinished").alias("truncated"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", "channel"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that end before they were finished."""
    return truncated(_documents(spark, sf_dir), "doc_id", "source").where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    t = truncated(_documents(spark, sf_dir), "doc_id", "source").groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("truncated").alias("n_truncated"))
    return t.withColumn("rate", F.round(F.col("n_truncated") / F.col("n_docs"), 6))
