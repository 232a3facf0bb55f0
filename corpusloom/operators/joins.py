"""Joins and set operations over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.windows import seeded_rank
from corpusloom.session import cut

def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done`` yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def complete_pairs(rows: DataFrame, key: str, side: Column) -> DataFrame:
    """Keys with exactly one row on either side (``side`` is true or false)."""
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(side).alias("l"), F.count_if(~side).alias("r"))
    return n.where("l = 1 and r = 1").select(key)


def key_sides(rows: DataFrame, key: str, side: Column) -> DataFrame:
    """Each key with ``both``, ``left`` or ``right``."""
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(side).alias("l"), F.max(~side).alias("r"))
    return n.select(key, F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right").alias("sides"))


def split_leakage(rows: DataFrame, digest: Column, split: Column) -> DataFrame:
    """Digests that occur in two splits, per pair of splits."""
    seen = rows.select(digest.alias("k"), split.alias("s")).distinct()
    return (
        seen.groupBy("k").agg(F.array_sort(F.collect_set("s")).alias("s")).where(F.size("s") > 1)
        # at most one entry a split and digest, so the pairs of one digest are few
        .select("k", F.explode("s").alias("split_a"), "s").select("k", "split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
        .groupBy("split_a", "split_b").agg(F.count("*").alias("n_shared"))
    )


def seeded(seed: int, key: Column) -> list[Column]:
    """Random but repeatable order, the same in every engine."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), key]


def match_tiers(left: DataFrame, right: DataFrame, key: str, tiers: list[list[str]], seed: int = 42) -> DataFrame:
    """Pair rows one to one, tier after tier, each right row used once.

    A tier numbers both sides in seeded order inside its key and joins equal
    numbers; what is left goes to the next tier. Null key values match nothing."""
    cols_all = list(dict.fromkeys(c for cols in tiers for c in cols))
    # Written once a tier: the next tier reads what is left, not the whole plan again.
    lo, ro, out = cut(left.select(*cols_all, key)), cut(right.select(*cols_all, key)), None
    for n, cols in enumerate(tiers):
        number = lambda d, cols=cols: seeded_rank(d.dropna(subset=cols).select(*cols, key), cols, seed, key, "_n")
        a = number(lo).select(*cols, "_n", F.col(key).alias("left_id"))
        b = number(ro).select(*cols, "_n", F.col(key).alias("right_id"))
        hit = a.join(b, [*cols, "_n"]).select("left_id", "right_id", F.lit(n).alias("tier"))
        hit = cut(hit)
        out = hit if out is None else out.unionByName(hit)
        if n + 1 < len(tiers):
            lo = lo.join(hit.select(F.col("left_id").alias(key)), key, "left_anti")
            ro = ro.join(hit.select(F.col("right_id").alias(key)), key, "left_anti")
    return out


def nearest_by(probes: DataFrame, pool: DataFrame, hard: list[str], probe_key: str, pool_key: str, size: str, k: int = 2) -> DataFrame:
    """The k pool rows nearest in ``size`` to each probe, inside equal hard keys.

    The sizes of the pool, each with its k least keys, are put on one axis with the
    probes; only the k sizes below and the k above can hold the nearest rows, so no
    probe meets the whole pool. Equal distances prefer the smaller size, then the
    smaller key."""
    kind, id_kind = pool.schema[size].dataType.simpleString(), pool.schema[pool_key].dataType.simpleString()
    least = Window.partitionBy(*hard, size).orderBy(pool_key)  # the limit is applied before the shuffle as well
    few = pool.select(*hard, size, pool_key).withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k)
    sizes = few.groupBy(*hard, size).agg(F.collect_list(pool_key).alias("ids"))
    both = sizes.select(*hard, F.col(size).alias("_s"), F.struct(F.col(size).alias("s"), "ids").alias("c"), F.lit(None).cast("long").alias("p")).unionByName(
        probes.select(*hard, F.col(size).alias("_s"), F.lit(None).cast(f"struct<s:{kind},ids:array<{id_kind}>>").alias("c"), F.col(probe_key).cast("long").alias("p"))
    )
    order = ["_s", F.col("c").isNull().cast("int"), "p"]
    w = Window.partitionBy(*hard)
    lower = w.orderBy(*order)
    n_pool = F.count("c").over(lower.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = both.withColumn("_at", n_pool)
    ranked = placed.where("c is not null").select(*hard, F.col("_at").alias("_pos"), "c")
    asks = placed.where("p is not null").select(*hard, "p", F.col("_s").alias("_ps"), F.explode(F.sequence(F.col("_at") - (k - 1), F.col("_at") + k)).alias("_pos"))
    near = asks.join(ranked, [*hard, "_pos"]).select("p", F.abs(F.col("c.s") - F.col("_ps")).cast("long").alias("distance"), F.col("c.s").alias("s"), F.explode("c.ids").alias("pool_id"))
    best = Window.partitionBy("p").orderBy("distance", "s", "pool_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("p").alias("probe_id"), "pool_id", "distance", "rank")
