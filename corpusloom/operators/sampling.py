"""Seeded, engine-independent sampling, balancing and splitting.

Every draw is an order by ``md5(seed|key), key``: fixed by the seed, without
replacement, the same however the rows are partitioned. Quotas are computed on
the small table of strata, never on rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import seeded
from corpusloom.operators.windows import ordinal, seeded_rank, take_per
from corpusloom.session import cut
from corpusloom.sources.readers import exists


def _all():  # noqa: ANN202 - WindowSpec over a table of strata
    return Window.partitionBy(F.lit(1))


def balance(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """As many rows of every group as the smallest has."""
    least = df.groupBy(by).agg(F.count("*").alias("c")).agg(F.min("c").alias("_k"))
    return seeded_rank(df, [by], seed, key, "_r").join(F.broadcast(least)).where("_r <= _k").drop("_r", "_k")


def quotas(df: DataFrame, n: int, strata: list[str]) -> DataFrame:
    """Largest-remainder shares of n per stratum (null-free strata)."""
    s = df.groupBy(*strata).agg(F.count("*").alias("cnt"))
    exact = F.lit(n) * F.col("cnt") / F.sum("cnt").over(_all()).cast("double")
    s = s.withColumn("_q", F.floor(exact)).withColumn("_f", F.round(exact - F.floor(exact), 9))
    place = F.row_number().over(_all().orderBy(F.desc("_f"), *strata))
    s = s.withColumn("_p", place).withColumn("_rem", F.lit(n) - F.sum("_q").over(_all()))
    return s.select(*strata, "cnt", (F.col("_q") + (F.col("_p") <= F.col("_rem")).cast("long")).cast("long").alias("quota"))


def downsample(df: DataFrame, n: int, strata: list[str], key: str, seed: int) -> DataFrame:
    """Stratified sample of n rows; all rows if there are no more."""
    q = quotas(df, n, strata).select(*strata, F.least("quota", "cnt").alias("quota"))
    r = df.join(F.broadcast(q), strata)
    return take_per(r, strata, F.col("quota"), key, seed).drop("quota")


def split_sizes(n: Column) -> tuple[Column, Column, Column]:
    """(train, val, test) of 75/15/10: whole parts for train and val, at least one
    for train, one for val from three rows on, the rest for test."""
    train = F.when(n > 0, F.greatest(F.lit(1), F.floor(n * F.lit(0.75)))).otherwise(0).cast("long")
    val = (F.floor(n * F.lit(0.15)) + ((n >= 3) & (F.floor(n * F.lit(0.15)) == 0)).cast("long")).cast("long")
    return train, val, (n - train - val).cast("long")


def stratified_split(df: DataFrame, strata: list[str], key: str, val: float, test: float, seed: int) -> DataFrame:
    """key and ``new_split``: per stratum test first, then val, then train."""
    n = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    size = lambda p: F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(p), 0).cast("long"))
    n = n.withColumn("_t", size(test)).withColumn("_v", size(val))
    same = None
    right = n.select(*(F.col(c).alias(f"_{c}") for c in strata), "_n", "_t", "_v")
    for c in strata:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    r = seeded_rank(df, strata, seed, key, "_r").join(F.broadcast(right), same)
    small = (F.col("_n") < 3) | (F.col("_n") - F.col("_t") - F.col("_v") <= 0)
    return r.select(key, F.when(small, "train").when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_t") + F.col("_v"), "val").otherwise("train").alias("new_split"))


def nested_split(df: DataFrame, strata: list[str], key: str, train: float, val: float, seed: int) -> DataFrame:
    """key and ``new_split``: a stratified train sample, a stratified val sample of the
    rest, and test."""
    n = df.count()
    a = cut(downsample(df, int(n * train), strata, key, seed).select(key))
    v = downsample(df.join(a, key, "left_anti"), int(n * val), strata, key, seed + 1).select(key)
    marks = a.withColumn("new_split", F.lit("train")).unionByName(v.withColumn("new_split", F.lit("val")))
    return df.select(key).join(marks, key, "left").withColumn("new_split", F.coalesce("new_split", F.lit("test")))


def stratified_or_random(df: DataFrame, n: int, strata: list[str], key: str, seed: int) -> DataFrame:
    """A stratified sample of n rows, or a plain one if a stratum has a single row."""
    if df.groupBy(*strata).count().where("count < 2").limit(1).count():
        return df.select(key).orderBy(*seeded(seed, F.col(key))).limit(n)
    return downsample(df, n, strata, key, seed).select(key)


def ensure_sample(spark: SparkSession, path: str, draw: Callable[[], DataFrame]) -> DataFrame:
    """The sample that stands at ``path``; drawn and written only if none does."""
    if not exists(spark, f"{path}/_SUCCESS"):
        draw().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def group_split(df: DataFrame, group: str, seed: int) -> DataFrame:
    """Rows with ``new_split``, equal for all rows of a group. Groups are ranked by
    hash across partitions, so their number does not matter."""
    g = df.select(group).distinct().withColumn("_o", F.concat(F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"))), F.lit("|"), F.lpad(F.col(group).cast("string"), 20, "0")))
    g = ordinal(g, "_o", "_r")
    total = g.agg(F.count("*").alias("_n"))
    g = g.join(F.broadcast(total))
    train, val, _ = split_sizes(F.col("_n"))
    g = g.select(group, F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test").alias("new_split"))
    return df.join(g, group)


def two_pools(df: DataFrame, by: str, first: str, n_first: int, n: int, key: str, seed: int) -> DataFrame:
    """Up to n_first of one pool, topped up to n from the rest."""
    order = seeded(seed, F.col(key))
    a = df.where(F.col(by) == first).orderBy(*order).limit(n_first)
    lack = a.agg((F.lit(n) - F.count("*")).alias("_k"))
    b = df.where(F.col(by) != first).orderBy(*order).limit(n)
    b = b.withColumn("_r", F.row_number().over(_all().orderBy(*order))).join(F.broadcast(lack)).where("_r <= _k").drop("_r", "_k")
    return a.unionByName(b)


def cover_then_fill(df: DataFrame, outer: list[str], inner: list[str], n: int, key: str, seed: int) -> DataFrame:
    """key and phase (0 covers outer groups, 1 inner groups, 2 fills) of n rows."""
    mark = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(seeded(seed, F.col(key)))])
    first = lambda by: df.groupBy(*by).agg(F.min(mark).alias("m")).select(F.col("m.o1").alias(key))
    a, b = first(outer).withColumn("_a", F.lit(True)), first(inner).withColumn("_b", F.lit(True))
    r = df.select(key).join(F.broadcast(a), key, "left").join(F.broadcast(b), key, "left")
    phase = F.when(F.col("_a"), 0).when(F.col("_b"), 1).otherwise(2)
    return r.select(key, phase.alias("phase")).orderBy("phase", *seeded(seed, F.col(key))).limit(n)
