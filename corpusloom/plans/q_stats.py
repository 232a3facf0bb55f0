"""Queries over statistics and metrics (M8-M24) and curves (W6, M14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import stats as S
from corpusloom.plans.q_aggregates import FEATURES, feature_columns
from corpusloom.plans.q_records import SPLIT, split_norm
from corpusloom.plans.registry import Tables, query

#: A score in [0, 1] made from the length, so that both engines can have it.
SCORE = "least(1.0e0, char_length / 2000.0e0)"
SCORED = f"SELECT core_row_id, label, source_family, lower(trim(split)) AS split, {SCORE} AS score FROM core_records WHERE label IN (0, 1) AND char_length IS NOT NULL"


def scored(t: Tables) -> DataFrame:
    s = F.least(F.lit(1.0), F.col("char_length") / F.lit(2000.0))
    return t("core_records").where("label in (0, 1) and char_length is not null").select("core_row_id", "label", "source_family", split_norm().alias("split"), s.alias("score"))


LONG = " UNION ALL ".join(f"SELECT '{k}' AS feature, label, CAST({e} AS DOUBLE) AS value FROM core_records WHERE text IS NOT NULL AND label IN (0, 1)" for k, e in FEATURES.items())


def long(t: Tables) -> DataFrame:
    r = t("core_records").where("text is not null and label in (0, 1)").select("label", *feature_columns())
    return S.long_form(r, list(FEATURES), "label")


_MW = f"""WITH l AS ({LONG}), r AS (SELECT feature, label, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0e0 AS rk FROM l),
s AS (SELECT feature, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, sum(rk) FILTER (WHERE label = 1) AS r1 FROM r GROUP BY 1),
ti AS (SELECT feature, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT feature, value, count(*) AS c FROM l GROUP BY 1, 2) GROUP BY 1)
"""
_U = "(r1 - n1 * (n1 + 1) / 2.0e0)"


@query("m16_mann_whitney", _MW + f"SELECT feature, n1, n0, {_U} AS u1, {_U} / (n1 * n0) AS auc, round(greatest(0.0e0, abs({_U} - n1 * n0 / 2.0e0) - 0.5e0) / sqrt(n1 * n0 / 12.0e0 * (n1 + n0 + 1 - ties / (CAST(n1 + n0 AS DOUBLE) * (n1 + n0 - 1)))), 6) AS z FROM s JOIN ti USING (feature)")
def m16_mann_whitney(t: Tables) -> DataFrame:
    return S.mann_whitney(long(t)).withColumn("z", F.round("z", 6))


@query("m16_p_values")
def m16_p_values(t: Tables) -> DataFrame:
    """Two-sided p with Bonferroni correction over the features."""
    r = S.mann_whitney(long(t))
    return r.select("feature", "z", S.two_sided_p("z").alias("p"), F.least(F.lit(1.0), S.two_sided_p("z") * len(FEATURES)).alias("p_bonferroni"))


@query(
    "m17_effect_sizes",
    f"""WITH l AS ({LONG}), g AS (SELECT feature, avg(value) FILTER (WHERE label = 1) AS m1, avg(value) FILTER (WHERE label = 0) AS m0, var_samp(value) FILTER (WHERE label = 1) AS v1, var_samp(value) FILTER (WHERE label = 0) AS v0,
 count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, stddev_pop(value) AS s, corr(CAST(label AS DOUBLE), value) AS r FROM l GROUP BY 1)
SELECT feature, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d_pooled, round((m1 - m0) / s, 6) AS d_overall, round(abs(m1 - m0) / s, 6) AS d_absolute, round(r, 6) AS point_biserial FROM g""",
)
def m17_effect_sizes(t: Tables) -> DataFrame:
    r = S.effect_sizes(long(t))
    return r.select("feature", *(F.round(c, 6).alias(c) for c in r.columns if c != "feature"))


@query("m19_correlations", "WITH f AS (SELECT length(text) AS chars, " + FEATURES["marks"] + " AS marks, " + FEATURES["digits"] + " AS digits FROM core_records WHERE text IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM f" for a, b in (("chars", "marks"), ("chars", "digits"), ("marks", "digits"))))
def m19_correlations(t: Tables) -> DataFrame:
    r = t("core_records").where("text is not null").select(*feature_columns())
    return S.correlations(r, list(FEATURES)).withColumn("r", F.round("r", 6))


_RANK = """WITH p AS ({scored}), h AS (SELECT {by} score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM p GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM h WINDOW w AS ({part} ORDER BY score DESC))"""


@query(
    "m8_rank_metrics",
    _RANK.format(scored=SCORED, by="source_family,", part="PARTITION BY source_family")
    + " SELECT source_family, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round(sum(q * (tp - p / 2.0e0)) / (sum(p) * sum(q)), 6) END AS roc_auc, round(CASE WHEN sum(p) > 0 THEN sum(p * tp / CAST(tp + fp AS DOUBLE)) / sum(p) END, 6) AS average_precision FROM c GROUP BY 1",
)
def m8_rank_metrics(t: Tables) -> DataFrame:
    r = S.rank_metrics(scored(t), ["source_family"], "label", "score")
    return r.withColumn("roc_auc", F.round("roc_auc", 6)).withColumn("average_precision", F.round("average_precision", 6))


def _d(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0e0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


_THR = f"WITH c AS (SELECT split, count(*) FILTER (WHERE label = 1 AND score >= 0.2) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.2) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.2) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.2) AS tn FROM ({SCORED}) GROUP BY 1) "


@query("m8_threshold_metrics", _THR + f"SELECT split, tp, fp, fn, tn, {_d('tp + tn', 'tp + fp + fn + tn')} AS accuracy, ({_d('tp', 'tp + fn')} + {_d('tn', 'tn + fp')}) / 2 AS balanced_accuracy, {_d('tp', 'tp + fp')} AS precision, {_d('tp', 'tp + fn')} AS recall, {_d('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c")
def m8_threshold_metrics(t: Tables) -> DataFrame:
    return S.threshold_metrics(scored(t), ["split"], "label", "score", 0.2)


@query("m9_predicted_rate", f"SELECT source_family, avg(CAST(score >= 0.2 AS INTEGER)) AS llm_predicted_rate FROM ({SCORED}) WHERE label = 1 GROUP BY 1")
def m9_predicted_rate(t: Tables) -> DataFrame:
    return scored(t).where("label = 1").groupBy("source_family").agg(F.avg((F.col("score") >= 0.2).cast("int")).alias("llm_predicted_rate"))


GRID = [round(0.1 + 0.05 * i, 2) for i in range(17)]


@query("m10_best_threshold", f"WITH g AS (SELECT unnest([{', '.join(f'{g}e0' for g in GRID)}]) AS threshold), p AS ({SCORED}), f AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp, count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn FROM g, p GROUP BY 1) SELECT threshold, {_d('2 * tp', '2 * tp + fp + fn')} AS f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def m10_best_threshold(t: Tables) -> DataFrame:
    return S.best_threshold(scored(t), "label", "score", GRID)


@query("m13_confusion", f"SELECT label, score >= 0.2 AS predicted, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE), 6) AS row_share FROM ({SCORED}) GROUP BY 1, 2")
def m13_confusion(t: Tables) -> DataFrame:
    from corpusloom.operators.aggregates import shares

    r = scored(t).withColumn("predicted", F.col("score") >= 0.2)
    return shares(r, ["label", "predicted"], ["label"], "row_share")


@query("m14_curve_points", _RANK.format(scored=SCORED, by="", part="") + " SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")
def m14_curve_points(t: Tables) -> DataFrame:
    r = scored(t).withColumn("_all", F.lit(1))
    return S.sweep(r, ["_all"], "label", "score").select("score", "tp", "fp")


@query(
    "m12_partition_report",
    f"SELECT coalesce(split, '(all)') AS split, coalesce(source_family, '(all)') AS source_family, count(*) AS n, avg(CAST((score >= 0.2) = (label = 1) AS INTEGER)) AS accuracy FROM ({SCORED}) GROUP BY GROUPING SETS ((), (split), (source_family)) HAVING count(*) >= 20",
)
def m12_partition_report(t: Tables) -> DataFrame:
    r = scored(t)
    g = r.groupingSets([[], ["split"], ["source_family"]], "split", "source_family").agg(F.count("*").alias("n"), F.avg(((F.col("score") >= 0.2) == (F.col("label") == 1)).cast("int")).alias("accuracy"))
    return g.where("n >= 20").select(F.coalesce("split", F.lit("(all)")).alias("split"), F.coalesce("source_family", F.lit("(all)")).alias("source_family"), "n", "accuracy")


@query("m15_delta", _RANK.format(scored=SCORED, by="split,", part="PARTITION BY split") + ", a AS (SELECT split, sum(q * (tp - p / 2.0e0)) / (sum(p) * sum(q)) AS auc FROM c GROUP BY 1) SELECT round(max(auc) FILTER (WHERE split = 'val') - max(auc) FILTER (WHERE split = 'test'), 6) AS delta FROM a")
def m15_delta(t: Tables) -> DataFrame:
    r = S.rank_metrics(scored(t), ["split"], "label", "score")
    at = lambda s: F.max(F.when(F.col("split") == s, F.col("roc_auc")))
    return r.agg(F.round(at("val") - at("test"), 6).alias("delta"))


@query("m21_mutual_information")
def m21_mutual_information(t: Tables) -> DataFrame:
    """Plug-in estimate over quantile bins (a different estimator from kNN)."""
    return S.mutual_information(scored(t), "label", "score")


@query("m24_drift", f"SELECT split, count(*) AS n, median(char_length) AS median_chars FROM (SELECT {SPLIT} AS split, char_length FROM core_records) GROUP BY 1 HAVING count(*) >= 30")
def m24_drift(t: Tables) -> DataFrame:
    return t("core_records").groupBy(split_norm().alias("split")).agg(F.count("*").alias("n"), F.median("char_length").alias("median_chars")).where("n >= 30")
