"""Counts, contingency tables and distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    """Counts per value, null being a value."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, rows: list[str], col: Column, values: list[str]) -> DataFrame:
    """Counts per row keys and one column per value; absent ones are 0."""
    return df.groupBy(*rows).agg(*(F.count_if(col.eqNullSafe(F.lit(v))).alias(v) for v in values))


def crosstab_margins(df: DataFrame, row: str, col: Column, values: list[str]) -> DataFrame:
    """As above with the row and column totals called ``All``."""
    body = df.withColumn("_c", col).rollup(row).agg(*(F.count_if(F.col("_c").eqNullSafe(F.lit(v))).alias(v) for v in values), F.count("*").alias("All"), F.grouping(row).alias("_g"))
    return body.select(F.when(F.col("_g") == 1, "All").otherwise(F.coalesce(row, F.lit("(none)"))).alias(row), *values, "All")


def shares(df: DataFrame, by: list[str], within: list[str], name: str = "share", digits: int = 6) -> DataFrame:
    """Counts per ``by`` and their share inside ``within`` (a prefix of ``by``).

    The window runs over the counted groups, not over rows."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn(name, F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))), digits))


def index_percentile(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """The value at index floor(n * q) of the sorted values, not interpolated.

    Values are counted first, so a group is as large as its distinct values."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    upto = hist.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_total", F.sum("_n").over(w))
    at = lambda p: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_total") * F.lit(p)), F.col("_total") - 1), F.col(value)))
    return upto.groupBy(*by).agg(F.max("_total").alias("n"), *(at(p).alias(name) for name, p in qs.items()))


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], digits: int = 6) -> DataFrame:
    """Interpolated quantiles with count, mean, standard deviation, extremes."""
    aggs = [F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_samp(value), digits).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    aggs += [F.round(F.percentile(value, p), digits).alias(name) for name, p in qs.items()]
    return df.groupBy(*by).agg(*aggs)


def dominant(df: DataFrame, by: str, most: float) -> DataFrame:
    """Values that hold more than ``most`` of all rows."""
    return shares(df, [by], []).where(F.col("share") > most)


def histogram(df: DataFrame, by: list[str], value: str, bins: int, clip: float = 0.99) -> DataFrame:
    """Counts in equal bins up to the ``clip`` quantile; larger values in the last."""
    top = df.agg(F.percentile(value, clip).alias("_top"))
    b = F.least(F.floor(F.col(value) * F.lit(bins) / F.greatest("_top", F.lit(1.0))), F.lit(bins - 1)).cast("long")
    return df.where(F.col(value).isNotNull()).join(F.broadcast(top)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
