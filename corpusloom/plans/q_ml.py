"""Queries over learning (M1-M7, M20-M23), top terms (L3), near-duplicates (J13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import features as X
from corpusloom.operators import ml as M
from corpusloom.operators import neardup as N
from corpusloom.operators import stats
from corpusloom.plans.q_records import split_norm
from corpusloom.plans.registry import Tables, query
from corpusloom.session import cut, remove_at_exit, shared_folder


def _features(t: Tables) -> tuple[DataFrame, list[str]]:
    r = t("core_records").where("label in (0, 1)").withColumn("slice", split_norm())
    h = cut(X.extract_hc60(r, ["core_row_id", "label", "slice"]))
    return h, [c for c in h.columns if c.startswith("hc60_")]


_SC = "SELECT core_row_id, CAST(char_length AS DOUBLE) AS a, CAST(token_length AS DOUBLE) AS b, lower(trim(split)) AS s FROM core_records"


@query("m2_scale", f"WITH r AS ({_SC}), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM r WHERE s = 'train') SELECT core_row_id, round((a - ma) / sa, 6) AS a, round((b - mb) / sb, 6) AS b FROM r, m")
def m2_scale(t: Tables) -> DataFrame:
    r = t("core_records").select("core_row_id", F.col("char_length").cast("double").alias("a"), F.col("token_length").cast("double").alias("b"), split_norm().alias("s"))
    return M.scale(r.where("s = 'train'"), r, ["a", "b"]).select("core_row_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("m3_impute", f"WITH r AS ({_SC}), m AS (SELECT median(a) AS ma FROM r WHERE s = 'train') SELECT core_row_id, coalesce(a, ma) AS a FROM r, m")
def m3_impute(t: Tables) -> DataFrame:
    r = t("core_records").select("core_row_id", F.col("char_length").cast("double").alias("a"), split_norm().alias("s"))
    return M.impute(r.where("s = 'train'"), r, ["a"]).select("core_row_id", "a")


@query("m4_fill", "SELECT event_id, coalesce(value, 0) AS value FROM events")
def m4_fill(t: Tables) -> DataFrame:
    v = F.col("value")
    return t("events").select("event_id", F.when(F.isnan(v) | v.isNull(), 0.0).otherwise(v).alias("value"))


_GRAM = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def _tfidf_sql(base: str, grams: str, table: str, key: str, where: str, last: str) -> str:
    """TF-IDF weights of the terms ``grams``, made from the list ``base`` (as b) of each text."""
    return f"""WITH d AS (SELECT {key}, {grams} AS w FROM (SELECT {key}, {base} AS b FROM {table} WHERE text IS NOT NULL{where})), n AS (SELECT count(*) AS n FROM d),
tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM d) GROUP BY 1, 2), v AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.95e0 * (SELECT n FROM n) ORDER BY sum(tf) DESC, term LIMIT 2000),
x AS (SELECT {key}, term, (1 + ln(tf)) * (ln((1.0e0 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)),
u AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM x)
{last}"""


_PAIRS = "b || list_transform(range(1, greatest(len(b), 1)), lambda k: b[k] || ' ' || b[k + 1])"
_PADDED = "list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda v: v <> ''), lambda v: ' ' || v || ' ')"
_CHARS = "flatten(list_transform(b, lambda v: flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, greatest(length(v) - n + 2, 1)), lambda i: substring(v, i, n))))))"


def _weights(t: Tables, terms) -> DataFrame:  # noqa: ANN001
    d = t("llm_mass_generation").where("text is not null").select("gen_id", terms.alias("terms"))
    counts, n = M.term_counts(d, "gen_id", "terms"), d.count()
    return M.tfidf_long(counts, "gen_id", M.vocabulary(counts, n, 2000), n).withColumn("weight", F.round("weight", 6))


@query("m1_tfidf", _tfidf_sql(_GRAM, _PAIRS, "llm_mass_generation", "gen_id", "", "SELECT gen_id, term, round(weight, 6) AS weight FROM u"))
def m1_tfidf(t: Tables) -> DataFrame:
    """Sublinear TF-IDF of word uni- and bigrams, unit length per text."""
    return _weights(t, M.word_grams(F.col("text")))


@query("m1_char_tfidf", _tfidf_sql(_PADDED, _CHARS, "llm_mass_generation", "gen_id", "", "SELECT gen_id, term, round(weight, 6) AS weight FROM u"))
def m1_char_tfidf(t: Tables) -> DataFrame:
    """The same of two to four characters inside padded words."""
    return _weights(t, M.char_grams(F.col("text")))


@query(
    "l3_top_terms",
    _tfidf_sql(
        _GRAM, "b", "core_records", "core_row_id", " AND label IN (0, 1)",
        """, l AS (SELECT label, count(*) AS n FROM core_records WHERE text IS NOT NULL AND label IN (0, 1) GROUP BY 1),
m AS (SELECT c.label, term, round(sum(weight) / max(l.n), 6) AS mean_weight FROM u JOIN core_records c USING (core_row_id) JOIN l ON l.label = c.label GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean_weight DESC, term) AS rank FROM m) SELECT label, term, mean_weight, rank FROM r WHERE rank <= 10""",
    ).replace("\n, l AS", ", l AS"),
)
def l3_top_terms(t: Tables) -> DataFrame:
    """Ten terms of the highest mean weight per label, zeros counted in."""
    d = t("core_records").where("text is not null and label in (0, 1)").select("core_row_id", "label", M.word_grams(F.col("text"), 1, 1).alias("terms"))
    counts, n = M.term_counts(d, "core_row_id", "terms"), d.count()
    size = d.groupBy("label").agg(F.count("*").alias("n"))
    w = M.tfidf_long(counts, "core_row_id", M.vocabulary(counts, n, 2000), n).join(d.select("core_row_id", "label"), "core_row_id")
    w = w.groupBy("label", "term").agg(F.sum("weight").alias("s")).join(F.broadcast(size), "label")
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("mean_weight"), "term"))
    return w.select("label", "term", F.round(F.col("s") / F.col("n"), 6).alias("mean_weight")).withColumn("rank", r).where("rank <= 10")


#: Slices of the sixty features, each a model of its own.
SLICES = {"length": (0, 10), "surface": (10, 17), "punctuation": (17, 26), "diversity": (26, 36), "functional": (36, 51), "discourse": (51, 60)}


def _splits(t: Tables) -> tuple[DataFrame, DataFrame, list[str]]:
    h, names = _features(t)
    train = h.where("slice = 'train'")
    return cut(M.scale(train, train, names)), cut(M.scale(train, h.where("slice != 'train'"), names)), names


@query("m7_model_suite")
def m7_model_suite(t: Tables) -> DataFrame:
    """Every model of the registry on all features, and logistic regression on each
    slice of them, fitted on train, reported per other split."""
    train, rest, names = _splits(t)
    specs = [(m, m, names) for m in M.registry(1)] + [(f"lr_{s}", "lr_l2_c1", names[a:b]) for s, (a, b) in SLICES.items()]
    out = None
    for label, name, features in specs:
        model, took = M.fit(train, name, features)
        got = M.evaluate(M.predict(model, rest), ["slice"], label).withColumn("train_time_s", F.lit(took))
        out = got if out is None else out.unionByName(got)
    return out


@query("m6_experiments")
def m6_experiments(t: Tables) -> DataFrame:
    """Three models on six feature sets (hand-made features, word and character terms
    and their unions); the best by F1 on val is fitted again on train and val and
    reported on test."""
    r = t("core_records").where("label in (0, 1)").select("core_row_id", "text", "label", split_norm().alias("slice"))
    h = X.extract_hc60(r, ["core_row_id", "label", "slice", "text"])
    names = [c for c in h.columns if c.startswith("hc60_")]
    h = cut(h)
    of = lambda s: h.where(F.col("slice") == s)
    m = cut(M.moments(of("train"), names))
    terms = {"words": M.word_grams(F.col("text"), 1, 1), "chars": M.char_grams(F.col("text"), 3, 3)}
    scaled = {s: M.scaled(of(s), m, names).select("label", *names, *(c.alias(k) for k, c in terms.items())) for s in ("train", "val", "test")}
    sets = {"hand": names, "words": ["words"], "chars": ["chars"], "hand+words": [*names, "words"], "hand+chars": [*names, "chars"], "all": [*names, "words", "chars"]}
    done = M.best_experiment(scaled["train"], scaled["val"], ["lr_l2_c1", "linear_svc", "sgd_log"], sets)
    best = done[0]
    own = sets[best["features"]]
    model = M.fit_terms(scaled["train"].unionByName(scaled["val"]).select("label", *own), best["model"], own)
    test = stats.threshold_metrics(M.predict(model, scaled["test"]).select(F.lit(1).alias("_all"), "label", "score"), ["_all"], "label", "score").first() or {"f1": None}
    rows = [(d["model"], d["features"], d["f1"], float(test["f1"] or 0.0) if d is best else None, d["train_time_s"], d["infer_time_per_sample"]) for d in done]
    return t.spark.createDataFrame(rows, "model string, features string, val_f1 double, test_f1 double, train_time_s double, infer_time_per_sample double")


@query("m6_ablation")
def m6_ablation(t: Tables) -> DataFrame:
    """Logistic regression on all features but one slice."""
    train, rest, names = _splits(t)
    out = None
    for block, (a, b) in SLICES.items():
        model, _ = M.fit(train, "lr_l2_c1", names[:a] + names[b:])
        got = M.evaluate(M.predict(model, rest), ["slice"], f"lr_without_{block}")
        out = got if out is None else out.unionByName(got)
    return out


@query("k9_model_round_trip")
def k9_model_round_trip(t: Tables) -> DataFrame:
    """Rows whose score by the saved and loaded pipeline differs from the fitted one's
    (none), and the meta that was kept."""
    train, rest, names = _splits(t)
    model, _ = M.fit(train, "lr_l2_c1", names)
    path = remove_at_exit(t.spark, shared_folder(t.spark, "k9"))
    M.save(model, path, {"features": len(names), "model": "lr_l2_c1"})
    again, meta = M.load(path)
    a, b = (M.predict(m, rest).select("core_row_id", F.col("score").alias(c)) for m, c in ((model, "a"), (again, "b")))
    return a.join(b, "core_row_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("a") != F.col("b")).alias("n_different")).withColumn("n_features", F.lit(meta["features"]))


@query("k10_error_rows")
def k10_error_rows(t: Tables) -> DataFrame:
    """Test rows that the model gets wrong, with their score, for error analysis."""
    train, rest, names = _splits(t)
    model, _ = M.fit(train, "lr_l2_c1", names)
    p = M.predict(model, rest.where("slice = 'test'")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return p.where("predicted != label").select("core_row_id", "label", "predicted", F.round("score", 6).alias("score"))


@query("m20_pca")
def m20_pca(t: Tables) -> DataFrame:
    h, names = _features(t)
    return M.project(M.scale(h, h, names), names).select("core_row_id", "label", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("m22_linear_attribution")
def m22_linear_attribution(t: Tables) -> DataFrame:
    h, names = _features(t)
    z = cut(M.scale(h, h, names))
    model, _ = M.fit(z, "lr_l2_c1", names)
    return M.linear_attribution(z, names, list(model.stages[-1].coefficients))


@query("m23_tree_importance")
def m23_tree_importance(t: Tables) -> DataFrame:
    h, names = _features(t)
    model, _ = M.fit(h, "random_forest", names)
    rows = [(n, float(v)) for n, v in zip(names, model.stages[-1].featureImportances.toArray())]
    return t.spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(30)


@query("j13_near_duplicates")
def j13_near_duplicates(t: Tables) -> DataFrame:
    """Class and number of links of every generated text (five-word shingles, 0.8)."""
    return N.classes(t("llm_mass_generation"), "gen_id", "text")
