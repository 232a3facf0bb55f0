"""Near-duplicate classes by exact Jaccard similarity of five-word shingles.

Prefix filtering: shingles are ordered from rare to frequent, and two sets with
Jaccard similarity of at least t must share one of their first
``n - ceil(t * n) + 1`` shingles. Only these are joined, so frequent shingles
propose no pairs; candidates are then checked exactly. Equal texts are one row
throughout, and classes are found by passing the smallest id along the links,
round after round, with each round written to the shared folder.

Defined results: null texts and texts without words take no part; a text shorter
than the shingle is one shingle; a text without neighbour is a class of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

SHINGLE, SIMILARITY = 5, 0.8


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Distinct hashes of k consecutive words."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " "))))


def links(docs: DataFrame, key: str, text: str, t: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of class ids with similarity; membership key, id)."""
    w = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    words = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.array_join(w, " ").alias("w")).where("w != ''")
    same = words.groupBy(F.md5("w").alias("h")).agg(F.min("key").alias("id"), F.first("w").alias("w"))
    member = words.select("key", F.md5("w").alias("h")).join(same.select("h", "id"), "h").select("key", "id")
    sets = cut(same.select("id", shingles(F.split("w", " ")).alias("s")).withColumn("n", F.size("s")))
    rows = sets.select("id", "n", F.explode("s").alias("x"))
    freq = rows.groupBy("x").agg(F.count("*").alias("f")).where("f > 1")  # a shingle of one text proposes nothing
    # Shingles of one text only come first in the order and propose nothing; the
    # others are placed behind them.
    known = rows.join(freq, "x").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("r"))
    prefix = F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1
    keep = F.greatest(F.lit(0), prefix - (F.col("n") - F.size("r"))).cast("int")
    offer = known.select("id", "n", F.explode(F.slice(F.col("r.x"), F.lit(1), keep)).alias("x"))
    a, b = offer.select("x", F.col("id").alias("a"), F.col("n").alias("na")), offer.select("x", F.col("id").alias("b"), F.col("n").alias("nb"))
    near = (F.col("na") >= F.lit(t) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(t) * F.col("na") - 1e-9)
    cand = a.join(b, "x").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    both = cand.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    sim = inter / (F.size("sa") + F.size("sb") - inter)
    return cut(both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= t - 1e-9)), member


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): smallest id of every linked group; ids without links are absent."""
    both = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("root")))
    for _ in range(rounds):
        heard = both.join(label.select(F.col("id").alias("v"), "root"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("m"))
        step = label.join(heard, "id", "left").select("id", F.least("root", F.coalesce("m", "root")).alias("r"))
        # Jump: take over the root of the root.
        jump = step.join(step.select(F.col("id").alias("r"), F.col("r").alias("rr")), "r", "left").select("id", F.least("r", F.coalesce("rr", "r")).alias("root"))
        new = cut(jump)
        changed = new.join(label.select("id", F.col("root").alias("o")), "id").where("root != o").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError("the links did not settle")


def classes(docs: DataFrame, key: str, text: str, t: float = SIMILARITY) -> DataFrame:
    """key, class_id, n_links (to different texts): one row a text-bearing row."""
    pairs, member = links(docs, key, text, t)
    root = components(pairs)
    n = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    r = member.join(root, "id", "left").join(n, "id", "left")
    return r.select(F.col("key").alias(key), F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
