"""Rank statistics, effect sizes and classification metrics.

Everything works on counts per distinct value (or score), so ties are groups and
a sort never carries more than the distinct values.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.windows import cumulative


def long_form(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """(feature, value, keep...): one row per row and feature."""
    cells = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    return df.select(*keep, F.expr(f"stack({len(features)}, {cells}) as (feature, value)"))


def mann_whitney(long: DataFrame, label: str = "label") -> DataFrame:
    """Per feature: sizes, U of label 1, AUC, z with tie and continuity correction."""
    h = long.where("value is not null").groupBy("feature", "value").agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    h = h.withColumn("n", F.col("n0") + F.col("n1"))
    c = cumulative(h, ["feature"], ["value"], ["n"])
    rank = F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)
    g = c.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(F.col("n1") * rank).alias("r1"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)
    prod, total = F.col("n1") * F.col("n0"), F.col("n1") + F.col("n0")
    sigma = F.sqrt(prod / F.lit(12.0) * (total + 1 - F.col("ties") / (total * (total - 1))))
    mean = prod / F.lit(2.0)
    z = F.when(sigma > 0, F.greatest(F.lit(0.0), F.abs(u - mean) - F.lit(0.5)) / sigma).otherwise(0.0)
    return g.select("feature", "n1", "n0", u.alias("u1"), F.try_divide(u, prod).alias("auc"), z.alias("z"))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x is not None and x == x else None)


def effect_sizes(long: DataFrame, label: str = "label") -> DataFrame:
    """Three named variants: pooled sample deviation, deviation of all values
    (population), absolute difference over it; and point-biserial correlation."""
    x = long.where("value is not null")
    one, zero = F.when(F.col(label) == 1, F.col("value")), F.when(F.col(label) == 0, F.col("value"))
    g = x.groupBy("feature").agg(
        F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"), F.count(one).alias("n1"), F.count(zero).alias("n0"), F.stddev_pop("value").alias("s"), F.corr(F.col(label).cast("double"), F.col("value")).alias("r")
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    d = F.col("m1") - F.col("m0")
    return g.select("feature", F.try_divide(d, pooled).alias("d_pooled"), F.try_divide(d, F.col("s")).alias("d_overall"), F.try_divide(F.abs(d), F.col("s")).alias("d_absolute"), F.col("r").alias("point_biserial"))


def sweep(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Per score (highest first): true and false positives down to it."""
    h = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    c = cumulative(h, by, [F.desc(score)], ["p", "q"])
    return c.select(*by, score, "p", "q", (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_q") + F.col("q")).alias("fp"))


def rank_metrics(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """ROC-AUC (null with one class) and average precision, tie-exact."""
    s = sweep(df, by, label, score)
    # Area: every negative at this score has tp - p positives above and p beside it.
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / F.lit(2.0)))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    g = s.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), area.alias("_a"), ap.alias("_ap"))
    return g.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_a") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"), F.try_divide(F.col("_ap"), F.col("n_pos")).alias("average_precision"))


def confusion(label: Column, hit: Column) -> dict[str, Column]:
    return {"tp": F.count_if((label == 1) & hit), "fp": F.count_if((label == 0) & hit), "fn": F.count_if((label == 1) & ~hit), "tn": F.count_if((label == 0) & ~hit)}


def threshold_metrics(df: DataFrame, by: list[str], label: str, score: str, at: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1; 0 where undefined."""
    g = df.where(F.col(score).isNotNull()).groupBy(*by).agg(*(c.alias(n) for n, c in confusion(F.col(label), F.col(score) >= at).items()))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(
        *by, "tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((div(tp, tp + fn) + div(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def best_threshold(df: DataFrame, label: str, score: str, grid: list[float]) -> DataFrame:
    """The first threshold of the grid with the highest F1. The grid is counted in
    one pass over the rows, one aggregate a threshold."""
    lab = F.col(label)
    cols = [F.struct(F.lit(g).alias("threshold"), *(c.alias(n) for n, c in confusion(lab, F.col(score) >= g).items())).alias(f"g{i}") for i, g in enumerate(grid)]
    r = df.agg(*cols).select(F.explode(F.array(*(f"g{i}" for i in range(len(grid))))).alias("g")).select("g.*")
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return r.select("threshold", f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of features, in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(f"p{i}" for i in range(len(pairs))))).alias("p")).select("p.*")


def mutual_information(df: DataFrame, label: str, value: str, bins: int = 10) -> DataFrame:
    """Mutual information of label and quantile bin (a plug-in estimate)."""
    edges = df.agg(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("_e"))
    b = F.size(F.filter("_e", lambda e: e < F.col(value)))
    n = df.where(F.col(value).isNotNull()).join(F.broadcast(edges)).groupBy(F.col(label).alias("l"), b.alias("b")).agg(F.count("*").alias("n"))
    tot = n.agg(F.sum("n").alias("t"))
    nl, nb = n.groupBy("l").agg(F.sum("n").alias("nl")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    j = n.join(nl, "l").join(nb, "b").join(F.broadcast(tot))
    return j.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nl") * F.col("nb")))).alias("mi"))
