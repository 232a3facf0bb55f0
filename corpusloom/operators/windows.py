"""Ranking without global windows, keep-first, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut


def ordinal(df: DataFrame, key: str, name: str, partitions: int | None = None) -> DataFrame:
    """Number rows 1, 2, 3 ... in the order of a unique, non-null key.

    Rows are sorted into ranges across partitions and written once; the sizes of
    the ranges (one row a partition) give each its offset, so no task ever sees
    more than its range."""
    n = partitions or max(1, df.sparkSession.sparkContext.defaultParallelism)
    placed = cut(df.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + inner).cast("long")).drop("_part", "_start")


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of every key by ``order``, which must be unique.

    A minimum over structs combines before the shuffle, so a key that fills a
    third of the table sends one row per task."""
    rest = [c for c in df.columns if c not in order]
    return df.groupBy(key.alias("_k")).agg(F.min(F.struct(*order, *rest)).alias("_r")).select("_r.*").select(*df.columns)


def first_known(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key, each column's first non-null value by ``order``, and the count."""
    value = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return df.groupBy(key).agg(*(value(c) for c in columns), F.count("*").alias("n_duplicate_rows"))


def seeded_rank(df: DataFrame, by: list[str], seed: int, key: str, name: str) -> DataFrame:
    """Rank rows inside each group in the order of ``md5(seed|key), key``.

    A group is cut into 256 ranges by the first hex digits of the hash; rows are
    numbered inside a range and offset by the sizes of the earlier ranges, which
    are counted with map-side combination. A group with a third of all rows is
    therefore ranked by 256 tasks, not by one. Null is a group of its own."""
    r = df.withColumn("__hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).withColumn("__bucket", F.substring("__hash", 1, 2))
    sizes = r.groupBy(*by, "__bucket").agg(F.count("*").alias("__count"))
    before = F.coalesce(F.sum("__count").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__bucket").alias("__range"), before.alias("__before"))
    same = F.col("__bucket") == F.col("__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inner = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__hash", key))
    return r.join(starts, same).withColumn(name, (F.col("__before") + inner).cast("long")).drop("__hash", "__bucket", "__range", "__before", *(f"__by_{c}" for c in by))


def take_per(df: DataFrame, strata: list[str], k: Column | int, key: str, seed: int) -> DataFrame:
    """At most k rows of every stratum in seeded order."""
    limit = F.lit(k) if isinstance(k, int) else k
    return seeded_rank(df, strata, seed, key, "_n").where(F.col("_n") <= limit).drop("_n")


def running(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running total before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def cumulative(df: DataFrame, by: list[str], order: list[Column | str], sums: list[str]) -> DataFrame:
    """``df`` with ``before_<s>`` for each sum: the total of the rows of the same
    group that sort before. Rows are sorted into ranges across partitions and
    written once; range totals (one row a partition and group) give the offsets,
    so neither a large group nor many distinct values meet in one task."""
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    placed = cut(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))
    part = placed.groupBy(*by, "_part").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    over = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("_part").alias("__part"), *(F.coalesce(F.sum(f"_t_{s}").over(over), F.lit(0)).alias(f"_o_{s}") for s in sums))
    same = F.col("_part") == F.col("__part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inner = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(starts), same)
    return out.withColumns({f"before_{s}": F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums}).drop("_part", "__part", *(f"__by_{c}" for c in by), *(f"_o_{s}" for s in sums))
