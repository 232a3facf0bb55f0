"""Queries over aggregation (A), windows (W), limits (L) and sampling (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import aggregates as A
from corpusloom.operators import joins as J
from corpusloom.operators import sampling as S
from corpusloom.operators import windows as W
from corpusloom.plans.q_records import FAMILY, SPLIT, family, split_norm
from corpusloom.plans.q_text import SQL_CHANNEL, TOKENS, channel_norm, q, sql_bin, sql_words
from corpusloom.plans.registry import Tables, query
from corpusloom.session import remove_at_exit, shared_folder

FAM = FAMILY.format(c="scenario_family")


def core(t: Tables) -> DataFrame:
    """Core records with their category values in one form."""
    return t("core_records").withColumn("family", family()).withColumn("channel", channel_norm()).withColumn("split", split_norm()).withColumn("bin", F.lower(F.trim("length_bin")))


CORE = f"SELECT * EXCLUDE (channel, split), {FAM} AS family, {SQL_CHANNEL} AS channel, {SPLIT} AS split, lower(trim(length_bin)) AS bin FROM core_records"
SPLITS, BINS = ["train", "val", "test"], ["short", "medium", "long"]


@query("a1_group_count", f"SELECT family, split, count(*) AS n FROM ({CORE}) GROUP BY 1, 2")
def a1_group_count(t: Tables) -> DataFrame:
    return A.value_counts(core(t), "family", "split")


@query("a2_value_counts", "SELECT dataset_source, count(*) AS n FROM core_records GROUP BY 1")
def a2_value_counts(t: Tables) -> DataFrame:
    return A.value_counts(t("core_records"), "dataset_source").orderBy(F.desc("n"), "dataset_source")


def _piv(col: str, values: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {col} = '{v}') AS {v}" for v in values)


@query("a3_crosstab", f"SELECT family, {_piv('split', SPLITS)} FROM ({CORE}) GROUP BY 1")
def a3_crosstab(t: Tables) -> DataFrame:
    return A.crosstab(core(t), ["family"], F.col("split"), SPLITS)


@query("a4_crosstab_two_keys", f"SELECT family, label, {_piv('split', SPLITS)} FROM ({CORE}) GROUP BY 1, 2")
def a4_crosstab_two_keys(t: Tables) -> DataFrame:
    return A.crosstab(core(t), ["family", "label"], F.col("split"), SPLITS)


@query("a5_crosstab_margins", f"SELECT CASE WHEN grouping(family) = 1 THEN 'All' ELSE coalesce(family, '(none)') END AS family, {_piv('split', SPLITS)}, count(*) AS \"All\" FROM ({CORE}) GROUP BY ROLLUP (family)")
def a5_crosstab_margins(t: Tables) -> DataFrame:
    return A.crosstab_margins(core(t), "family", F.col("split"), SPLITS)


@query("a6_row_shares", f"SELECT family, bin, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY family) AS DOUBLE), 6) AS share FROM ({CORE}) GROUP BY 1, 2")
def a6_row_shares(t: Tables) -> DataFrame:
    return A.shares(core(t), ["family", "bin"], ["family"])


@query("a7_fixed_columns", f"SELECT channel, {_piv('bin', BINS + ['huge'])} FROM ({CORE}) GROUP BY 1")
def a7_fixed_columns(t: Tables) -> DataFrame:
    return A.crosstab(core(t), ["channel"], F.col("bin"), [*BINS, "huge"])


_DESC = "count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max"


@query("a8_named_aggregates", f"SELECT dataset_source, {_DESC}, round(quantile_cont(v, 0.5), 6) AS p50 FROM (SELECT dataset_source, length(text) AS v FROM core_records) GROUP BY 1")
def a8_named_aggregates(t: Tables) -> DataFrame:
    return A.quantiles(t("core_records").select("dataset_source", F.length("text").alias("v")), ["dataset_source"], "v", {"p50": 0.5})


@query("a9_describe", f"SELECT {_DESC}, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.99), 6) AS p99 FROM (SELECT length(text) AS v FROM documents)")
def a9_describe(t: Tables) -> DataFrame:
    return A.quantiles(t("documents").select(F.length("text").alias("v")), [], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99})


@query(
    "a10_index_percentile",
    """SELECT source, count(*) AS n, list_sort(list(v))[1 + least(CAST(floor(count(*) * 0.5e0) AS BIGINT), count(*) - 1)] AS p50, list_sort(list(v))[1 + least(CAST(floor(count(*) * 0.9e0) AS BIGINT), count(*) - 1)] AS p90
 FROM (SELECT source, length(text) AS v FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
)
def a10_index_percentile(t: Tables) -> DataFrame:
    return A.index_percentile(t("documents").select("source", F.length("text").alias("v")), ["source"], "v", {"p50": 0.5, "p90": 0.9})


@query("a11_quantile", "SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.1), 6) AS p10 FROM documents GROUP BY 1")
def a11_quantile(t: Tables) -> DataFrame:
    return t("documents").groupBy("lang").agg(F.round(F.percentile("n_chars", 0.5), 6).alias("median"), F.round(F.percentile("n_chars", 0.1), 6).alias("p10"))


FEATURES = {"chars": "length(text)", "marks": "coalesce(CAST(len(regexp_extract_all(text, '[.!?]+')) AS BIGINT), 0)", "digits": "length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))"}


def feature_columns() -> list:
    c = F.col("text")
    return [F.length(c).alias("chars"), X.sentence_marks(c).alias("marks"), (F.length(c) - F.length(F.regexp_replace(c, "[0-9]", ""))).alias("digits")]


@query(
    "a12_means_per_label",
    " UNION ALL ".join(f"SELECT '{k}' AS feature, label, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS std FROM core_records WHERE text IS NOT NULL GROUP BY label" for k, e in FEATURES.items()),
)
def a12_means_per_label(t: Tables) -> DataFrame:
    r = t("core_records").where("text is not null").select("label", *feature_columns())
    wide = r.groupBy("label").agg(*(F.round(f(k), 6).alias(f"{k}_{n}") for k in FEATURES for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
    cells = ", ".join(f"'{k}', {k}_mean, {k}_std" for k in FEATURES)
    return wide.select("label", F.expr(f"stack({len(FEATURES)}, {cells}) as (feature, mean, std)"))


@query("a13_duplicate_rate", "SELECT source_family, count(*) AS n, count(DISTINCT md5(trim(coalesce(text, '')))) AS n_unique, round(1 - count(DISTINCT md5(trim(coalesce(text, '')))) / CAST(count(*) AS DOUBLE), 6) AS duplicate_rate FROM core_records GROUP BY 1")
def a13_duplicate_rate(t: Tables) -> DataFrame:
    r = t("core_records").groupBy("source_family", X.md5_key(F.col("text")).alias("k")).agg(F.count("*").alias("c"))
    return r.groupBy("source_family").agg(F.sum("c").alias("n"), F.count("*").alias("n_unique"), F.round(1 - F.count("*") / F.sum("c"), 6).alias("duplicate_rate"))


@query("a14_nunique_with_null", "SELECT dataset_source, count(DISTINCT channel) + CAST(bool_or(channel IS NULL) AS BIGINT) AS n_channels FROM core_records GROUP BY 1")
def a14_nunique_with_null(t: Tables) -> DataFrame:
    return t("core_records").groupBy("dataset_source").agg((F.count_distinct("channel") + F.max(F.col("channel").isNull()).cast("long")).alias("n_channels"))


@query("a15_dominance", "SELECT source, n, share FROM (SELECT source, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM documents GROUP BY 1) WHERE share > 0.05")
def a15_dominance(t: Tables) -> DataFrame:
    return A.dominant(t("documents"), "source", 0.05)


_OPEN = f"lower(array_to_string({sql_words('text')}[1:8], ' '))"


@query(
    "a16_common_opening",
    f"""WITH o AS (SELECT subtype, {_OPEN} AS opening, count(*) AS n FROM llm_mass_generation WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT subtype, max(n) AS n_most, CAST(sum(n) AS BIGINT) AS n_all, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS share, max(n) / CAST(sum(n) AS DOUBLE) > 0.3e0 AS flagged FROM o GROUP BY 1""",
)
def a16_common_opening(t: Tables) -> DataFrame:
    o = t("llm_mass_generation").where("text is not null").groupBy("subtype", X.opening(F.col("text")).alias("opening")).agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return o.groupBy("subtype").agg(F.max("n").alias("n_most"), F.sum("n").alias("n_all"), F.round(share, 6).alias("share"), (share > 0.3).alias("flagged"))


@query(
    "a17_histogram",
    """WITH v AS (SELECT label, length(text) AS v FROM core_records WHERE text IS NOT NULL), top AS (SELECT greatest(quantile_cont(v, 0.99), 1.0e0) AS top FROM v)
SELECT label, CAST(least(floor(v * 20 / top), 19) AS BIGINT) AS bin, count(*) AS n FROM v, top GROUP BY 1, 2""",
)
def a17_histogram(t: Tables) -> DataFrame:
    return A.histogram(t("core_records").where("text is not null").select("label", F.length("text").alias("v")), ["label"], "v", 20)


@query("a18_token_totals", "SELECT label, CAST(sum(coalesce(len(regexp_extract_all(text, '\\[URL\\]')), 0)) AS BIGINT) AS n_urls, round(avg(CAST(coalesce(contains(text, '@'), false) AS INTEGER)), 6) AS with_mail FROM core_records GROUP BY 1")
def a18_token_totals(t: Tables) -> DataFrame:
    urls = F.sum(F.coalesce(F.regexp_count("text", F.lit(r"\[URL\]")), F.lit(0))).cast("long")
    return t("core_records").groupBy("label").agg(urls.alias("n_urls"), F.round(F.avg(F.coalesce(F.contains("text", F.lit("@")), F.lit(False)).cast("int")), 6).alias("with_mail"))


_YEAR = f"CAST(nullif(regexp_extract(coalesce(date_raw, ''), {q(X.YEAR)}, 1), '') AS INTEGER)"


@query("a19_year_span", f"SELECT subset, min({_YEAR}) AS first_year, max({_YEAR}) AS last_year FROM enron_ham_annotated GROUP BY 1")
def a19_year_span(t: Tables) -> DataFrame:
    y = X.first_year(F.col("date_raw"))
    return t("enron_ham_annotated").groupBy("subset").agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"))


SOURCES = {"enron_ham_annotated": "text", "nigerian_fraud_prepared": "raw_body", "smishtank_prepared": "text", "mendeley_smishing_prepared": "text"}


@query("a20_source_summary", " UNION ALL ".join(f"SELECT '{n}' AS src, count(*) AS n, count(DISTINCT {c}) AS n_unique, count(*) FILTER (WHERE {c} IS NULL) AS n_null, max(length({c})) AS longest, round(quantile_cont(length({c}), 0.5), 6) AS median FROM {n}" for n, c in SOURCES.items()))
def a20_source_summary(t: Tables) -> DataFrame:
    parts = [
        t(n).select(F.lit(n).alias("src"), F.col(c).alias("x"), F.xxhash64(c).alias("h")).groupBy("src").agg(
            F.count("*").alias("n"), F.count_distinct("x").alias("n_unique"), F.count_if(F.col("x").isNull()).alias("n_null"), F.max(F.length("x")).alias("longest"), F.round(F.percentile(F.length("x"), 0.5), 6).alias("median")
        )
        for n, c in SOURCES.items()
    ]
    return J.union_all(*parts)


@query("a21_generation_summary", "SELECT scenario_family, count(*) AS n, round(avg(CAST(actual_bin = target_bin AS INTEGER)), 6) AS match_rate, round(quantile_cont(token_count, 0.5), 6) AS p50, round(quantile_cont(token_count, 0.9), 6) AS p90 FROM llm_mass_generation GROUP BY 1")
def a21_generation_summary(t: Tables) -> DataFrame:
    return t("llm_mass_generation").groupBy("scenario_family").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("actual_bin") == F.col("target_bin")).cast("int")), 6).alias("match_rate"), F.round(F.percentile("token_count", 0.5), 6).alias("p50"), F.round(F.percentile("token_count", 0.9), 6).alias("p90")
    )


_CONF = "lower(trim(annotation_confidence))"


@query("a22_annotation_summary", f"SELECT category, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, count(*) FILTER (WHERE {_CONF} = 'high') AS high, count(*) FILTER (WHERE {_CONF} = 'medium') AS medium, count(*) FILTER (WHERE {_CONF} = 'low') AS low FROM enron_ham_annotated GROUP BY 1")
def a22_annotation_summary(t: Tables) -> DataFrame:
    c = F.lower(F.trim("annotation_confidence"))
    g = t("enron_ham_annotated").groupBy("category").agg(F.count("*").alias("n"), *(F.count_if(c == v).alias(v) for v in ("high", "medium", "low")))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query("a23_grouping_sets", f"SELECT split, label, source_family, count(*) AS n FROM ({CORE}) GROUP BY GROUPING SETS ((split), (split, label), (split, source_family))")
def a23_grouping_sets(t: Tables) -> DataFrame:
    c = core(t)
    return c.groupingSets([["split"], ["split", "label"], ["split", "source_family"]], "split", "label", "source_family").agg(F.count("*").alias("n"))


@query("a24_bin_shares", f"SELECT dataset_source, {sql_bin(TOKENS, SQL_CHANNEL)} AS bin, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY dataset_source) AS DOUBLE), 6) AS share FROM core_records GROUP BY 1, 2")
def a24_bin_shares(t: Tables) -> DataFrame:
    r = t("core_records").select("dataset_source", X.length_bin(X.token_count(F.col("text")), channel_norm()).alias("bin"))
    return A.shares(r, ["dataset_source", "bin"], ["dataset_source"])


@query("a25_stream_medians", f"SELECT subset, round(quantile_cont(len({sql_words('text')}), 0.5), 6) AS median_words, round(avg(CAST(has_url AS INTEGER)), 6) AS url_rate FROM enron_ham_annotated GROUP BY 1")
def a25_stream_medians(t: Tables) -> DataFrame:
    return t("enron_ham_annotated").groupBy("subset").agg(F.round(F.percentile(X.word_count(F.col("text")), 0.5), 6).alias("median_words"), F.round(F.avg(F.col("has_url").cast("int")), 6).alias("url_rate"))


@query(
    "a26_collisions",
    "SELECT k.core_row_id AS dropped_id, f.kept_id FROM core_records k JOIN (SELECT md5(text) AS h, min(core_row_id) AS kept_id FROM core_records WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) f ON md5(k.text) = f.h WHERE k.core_row_id <> f.kept_id",
)
def a26_collisions(t: Tables) -> DataFrame:
    r = t("core_records").where("text is not null").select("core_row_id", F.md5("text").alias("h"))
    kept = r.groupBy("h").agg(F.min("core_row_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1")
    return r.join(kept, "h").where("core_row_id != kept_id").select(F.col("core_row_id").alias("dropped_id"), "kept_id")


@query(
    "a27_audit_samples",
    "SELECT category, rec_id, rank FROM (SELECT category, rec_id, row_number() OVER (PARTITION BY category ORDER BY md5('7|' || rec_id), rec_id) AS rank FROM enron_ham_annotated) WHERE rank <= 2",
)
def a27_audit_samples(t: Tables) -> DataFrame:
    """Two seeded examples per category (group limit before the sort)."""
    w = Window.partitionBy("category").orderBy(*J.seeded(7, F.col("rec_id")))
    return t("enron_ham_annotated").select("category", "rec_id", F.row_number().over(w).alias("rank")).where("rank <= 2")


# ---- windows, top-k ---------------------------------------------------------------


@query("w1_keep_first", "SELECT min(core_row_id) AS core_row_id FROM core_records WHERE text IS NOT NULL GROUP BY md5(text)")
def w1_keep_first(t: Tables) -> DataFrame:
    r = t("core_records").where("text is not null").select("core_row_id", "text")
    return W.keep_first(r, F.md5("text"), ["core_row_id"]).select("core_row_id")


@query("w2_first_known", "SELECT text, arg_min(sms_fraud_subtype, rec_id) FILTER (WHERE sms_fraud_subtype IS NOT NULL) AS sms_fraud_subtype, arg_min(has_url, rec_id) FILTER (WHERE has_url IS NOT NULL) AS has_url, count(*) AS n_duplicate_rows FROM mendeley_smishing_prepared GROUP BY 1")
def w2_first_known(t: Tables) -> DataFrame:
    return W.first_known(t("mendeley_smishing_prepared"), "text", "rec_id", ["sms_fraud_subtype", "has_url"])


@query("w5_average_ranks", "SELECT core_row_id, rank() OVER (PARTITION BY source_family ORDER BY char_length) + (count(*) OVER (PARTITION BY source_family, char_length) - 1) / 2.0e0 AS rank FROM core_records WHERE char_length IS NOT NULL")
def w5_average_ranks(t: Tables) -> DataFrame:
    """Average ranks from the counts of values, not from a sort of all rows."""
    r = t("core_records").where("char_length is not null")
    h = r.groupBy("source_family", "char_length").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("source_family").orderBy("char_length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.withColumn("rank", below + (F.col("n") + 1) / F.lit(2.0)).select("source_family", "char_length", "rank")
    return r.select("core_row_id", "source_family", "char_length").join(h, ["source_family", "char_length"]).select("core_row_id", "rank")


@query("w7_running_offsets", "SELECT subtype, n, CAST(coalesce(sum(n) OVER (ORDER BY subtype ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT coalesce(subtype, '(none)') AS subtype, count(*) AS n FROM llm_mass_generation GROUP BY 1)")
def w7_running_offsets(t: Tables) -> DataFrame:
    """Start offsets of batches; the window is over the batches, a small table."""
    g = t("llm_mass_generation").groupBy(F.coalesce("subtype", F.lit("(none)")).alias("subtype")).agg(F.count("*").alias("n"))
    return W.running(g.withColumn("_all", F.lit(1)), ["_all"], ["subtype"], "n", "start").select("subtype", "n", "start")


@query("w8_row_ids", "SELECT gen_id, row_number() OVER (ORDER BY gen_id) - 1 AS row_id FROM llm_mass_generation")
def w8_row_ids(t: Tables) -> DataFrame:
    return W.ordinal(t("llm_mass_generation").select("gen_id"), "gen_id", "n").select("gen_id", (F.col("n") - 1).alias("row_id"))


@query("w9_round_robin", "SELECT target_id, ['short', 'medium', 'long'][(target_id % 3) + 1] AS bin FROM sample_targets")
def w9_round_robin(t: Tables) -> DataFrame:
    pool = F.array(*(F.lit(b) for b in BINS))
    return t("sample_targets").select("target_id", F.element_at(pool, F.pmod("target_id", F.lit(3)).cast("int") + 1).alias("bin"))


@query("l1_top_k", "SELECT core_row_id, char_length FROM core_records ORDER BY char_length DESC NULLS LAST, core_row_id LIMIT 10")
def l1_top_k(t: Tables) -> DataFrame:
    return t("core_records").select("core_row_id", "char_length").orderBy(F.desc_nulls_last("char_length"), "core_row_id").limit(10)


@query("l2_report_sort", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def l2_report_sort(t: Tables) -> DataFrame:
    return t("documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy("source", F.desc("n"), "lang")


@query("l4_sample_of_issues", "SELECT gen_id FROM llm_mass_generation WHERE coalesce(len(qc_issues), 0) > 0 ORDER BY gen_id LIMIT 25")
def l4_sample_of_issues(t: Tables) -> DataFrame:
    return t("llm_mass_generation").where(F.coalesce(F.size("qc_issues"), F.lit(0)) > 0).select("gen_id").orderBy("gen_id").limit(25)


@query(
    "l5_budget",
    "SELECT subset, least(n, greatest(300 - before, 0)) AS granted FROM (SELECT subset, n, CAST(coalesce(sum(n) OVER (ORDER BY subset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT coalesce(subset, '(none)') AS subset, count(*) AS n FROM enron_ham_annotated GROUP BY 1))",
)
def l5_budget(t: Tables) -> DataFrame:
    """How much of a budget of 300 each stream gets, in order."""
    g = t("enron_ham_annotated").groupBy(F.coalesce("subset", F.lit("(none)")).alias("subset")).agg(F.count("*").alias("n")).withColumn("_all", F.lit(1))
    r = W.running(g, ["_all"], ["subset"], "n", "before")
    return r.select("subset", F.least("n", F.greatest(F.lit(300) - F.col("before"), F.lit(0))).alias("granted"))


# ---- sampling -----------------------------------------------------------------------


@query("b1_caps", "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS n FROM documents) WHERE n <= CASE WHEN source IN ('enron_archive', 'sms_corpus') THEN 30 ELSE 20 END")
def b1_caps(t: Tables) -> DataFrame:
    cap = F.when(F.col("source").isin("enron_archive", "sms_corpus"), 30).otherwise(20)
    return W.take_per(t("documents").select("doc_id", "source"), ["source"], cap, "doc_id", 42).select("doc_id")


@query("b2_separate_held_out", "SELECT coalesce(contains(lower(origin_model), 'claude'), false) AS held, count(*) AS n FROM core_records WHERE label = 1 GROUP BY 1")
def b2_separate_held_out(t: Tables) -> DataFrame:
    from corpusloom.operators.records import held_out

    return t("core_records").where("label = 1").groupBy(held_out(F.col("origin_model")).alias("held")).agg(F.count("*").alias("n"))


@query(
    "b3_companion_quota",
    """WITH g AS (SELECT coalesce(family, '(none)') AS family, count(*) AS n FROM (SELECT * FROM (""" + CORE + """) WHERE label = 0) GROUP BY 1)
SELECT family, least(n, greatest(1, CAST(round_even(200 * n / CAST(sum(n) OVER () AS DOUBLE), 0) AS BIGINT))) AS quota FROM g""",
)
def b3_companion_quota(t: Tables) -> DataFrame:
    """Proportional share of 200 companions per family, at least one."""
    g = core(t).where("label = 0").groupBy(F.coalesce("family", F.lit("(none)")).alias("family")).agg(F.count("*").alias("n"))
    part = F.bround(F.lit(200) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 0).cast("long")
    return g.select("family", F.least("n", F.greatest(F.lit(1), part)).alias("quota"))


@query("b4_companion_size", "SELECT greatest(50, CAST(round_even(0.07e0 * count(*), 0) AS BIGINT)) AS n FROM core_records WHERE label = 0")
def b4_companion_size(t: Tables) -> DataFrame:
    return t("core_records").where("label = 0").agg(F.greatest(F.lit(50), F.bround(F.lit(0.07) * F.count("*"), 0).cast("long")).alias("n"))


_BAL = """WITH n AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM core_records WHERE label IN (0, 1) GROUP BY label))
SELECT core_row_id FROM (SELECT core_row_id, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || core_row_id), core_row_id) AS r FROM core_records WHERE label IN (0, 1)), n WHERE r <= k"""


@query("b6_balance_classes", _BAL)
def b6_balance_classes(t: Tables) -> DataFrame:
    """The smaller class whole, as many of the larger in seeded order."""
    return S.balance(t("core_records").where("label in (0, 1)").select("core_row_id", "label"), "label", "core_row_id", 42).select("core_row_id")


@query("b5_balance_groups", _BAL.replace("label", "fraudness").replace("fraudness IN (0, 1)", "fraudness IN ('fraud', 'legitimate')"))
def b5_balance_groups(t: Tables) -> DataFrame:
    return S.balance(t("core_records").where("fraudness in ('fraud', 'legitimate')").select("core_row_id", "fraudness"), "fraudness", "core_row_id", 42).select("core_row_id")


@query(
    "b7_stratified_split",
    f"""WITH r AS (SELECT core_row_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY label, family) AS n FROM ({CORE}) WINDOW w AS (PARTITION BY label, family ORDER BY md5('42|' || core_row_id), core_row_id)),
k AS (SELECT *, greatest(1, CAST(round_even(n * 0.07e0, 0) AS BIGINT)) AS n_test, greatest(1, CAST(round_even(n * 0.13e0, 0) AS BIGINT)) AS n_val FROM r)
SELECT core_row_id, CASE WHEN n < 3 OR n - n_test - n_val <= 0 THEN 'train' WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val' ELSE 'train' END AS new_split FROM k""",
)
def b7_stratified_split(t: Tables) -> DataFrame:
    return S.stratified_split(core(t).select("core_row_id", "label", "family"), ["label", "family"], "core_row_id", 0.13, 0.07, 42)


_QUOTA = """WITH s AS (SELECT coalesce(family, '') AS family, coalesce(bin, '') AS bin, count(*) AS cnt FROM ({core}) GROUP BY 1, 2), t AS (SELECT sum(cnt) AS total FROM s),
f AS (SELECT *, floor(500 * cnt / CAST(total AS DOUBLE)) AS q0, 500 * cnt / CAST(total AS DOUBLE) - floor(500 * cnt / CAST(total AS DOUBLE)) AS frac FROM s, t),
u AS (SELECT *, row_number() OVER (ORDER BY round(frac, 9) DESC, family, bin) AS place, 500 - sum(q0) OVER () AS rem FROM f),
quota AS (SELECT family, bin, CAST(q0 AS BIGINT) + CASE WHEN place <= rem THEN 1 ELSE 0 END AS quota FROM u)"""


@query(
    "b9_largest_remainder",
    _QUOTA.format(core=CORE)
    + f""" SELECT core_row_id FROM (SELECT core_row_id, coalesce(family, '') AS family, coalesce(bin, '') AS bin, row_number() OVER (PARTITION BY coalesce(family, ''), coalesce(bin, '') ORDER BY md5('42|' || core_row_id), core_row_id) AS r FROM ({CORE})) JOIN quota USING (family, bin) WHERE r <= quota""",
)
def b9_largest_remainder(t: Tables) -> DataFrame:
    """Stratified sample of 500 by largest remainders."""
    r = core(t).select("core_row_id", F.coalesce("family", F.lit("")).alias("family"), F.coalesce("bin", F.lit("")).alias("bin"))
    return S.downsample(r, 500, ["family", "bin"], "core_row_id", 42).select("core_row_id")


@query("w3_quota", _QUOTA.format(core=CORE) + " SELECT family, bin, quota FROM quota")
def w3_quota(t: Tables) -> DataFrame:
    r = core(t).select(F.coalesce("family", F.lit("")).alias("family"), F.coalesce("bin", F.lit("")).alias("bin"))
    return S.quotas(r, 500, ["family", "bin"]).select("family", "bin", "quota")


@query("w4_take_k", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY md5('3|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def w4_take_k(t: Tables) -> DataFrame:
    return W.take_per(t("documents").select("doc_id", "source", "lang"), ["source", "lang"], 5, "doc_id", 3).select("doc_id")


@query("b10_adaptive_strata", f"SELECT family, count(DISTINCT time_band) > 1 AS use_time_band, count(DISTINCT origin_model) > 1 AS use_model FROM ({CORE}) GROUP BY 1")
def b10_adaptive_strata(t: Tables) -> DataFrame:
    return core(t).groupBy("family").agg((F.count_distinct("time_band") > 1).alias("use_time_band"), (F.count_distinct("origin_model") > 1).alias("use_model"))


@query(
    "b12_budgets",
    f"""WITH n AS (SELECT family, count(*) FILTER (WHERE label = 0) AS human, count(*) FILTER (WHERE label = 1 AND NOT h) AS seen, count(*) FILTER (WHERE label = 1 AND h) AS held
 FROM (SELECT *, coalesce(contains(lower(origin_model), 'claude'), false) AS h FROM ({CORE})) WHERE family IS NOT NULL GROUP BY 1)
SELECT family, least(3000, human, seen) AS main, least(CAST(round_even(0.25e0 * least(3000, human, seen), 0) AS BIGINT), held) AS holdout FROM n""",
)
def b12_budgets(t: Tables) -> DataFrame:
    from corpusloom.operators.records import held_out

    h = held_out(F.col("origin_model"))
    n = core(t).where("family is not null").groupBy("family").agg(F.count_if(F.col("label") == 0).alias("human"), F.count_if((F.col("label") == 1) & ~h).alias("seen"), F.count_if((F.col("label") == 1) & h).alias("held"))
    main = F.least(F.lit(3000), "human", "seen")
    return n.select("family", main.alias("main"), F.least(F.bround(F.lit(0.25) * main, 0).cast("long"), "held").alias("holdout"))


@query("b11_two_lanes", f"SELECT family, n_a, n_b, least(n_a, CAST(round_even(100 * n_a / CAST(n_a + n_b AS DOUBLE), 0) AS BIGINT)) AS q_a, 100 - least(n_a, CAST(round_even(100 * n_a / CAST(n_a + n_b AS DOUBLE), 0) AS BIGINT)) AS q_b FROM (SELECT family, count(*) FILTER (WHERE source_family = 'llm_seen_openai') AS n_a, count(*) FILTER (WHERE source_family = 'llm_seen_mistral') AS n_b FROM ({CORE}) WHERE family IS NOT NULL GROUP BY 1) WHERE n_a + n_b > 0")
def b11_two_lanes(t: Tables) -> DataFrame:
    """100 places shared by two lanes in proportion to what they have."""
    n = core(t).where("family is not null").groupBy("family").agg(F.count_if(F.col("source_family") == "llm_seen_openai").alias("n_a"), F.count_if(F.col("source_family") == "llm_seen_mistral").alias("n_b")).where("n_a + n_b > 0")
    q_a = F.least("n_a", F.bround(F.lit(100) * F.col("n_a") / (F.col("n_a") + F.col("n_b")), 0).cast("long"))
    return n.select("family", "n_a", "n_b", q_a.alias("q_a"), (F.lit(100) - q_a).alias("q_b"))


_TRAIN = "CAST(greatest(1, floor(n * 0.75e0)) AS BIGINT)"
_VAL = "CAST(floor(n * 0.15e0) AS BIGINT) + CASE WHEN n >= 3 AND floor(n * 0.15e0) = 0 THEN 1 ELSE 0 END"


@query("b14_split_sizes", f"SELECT family, n, n_train, n_val, n - n_train - n_val AS n_test FROM (SELECT family, n, {_TRAIN} AS n_train, {_VAL} AS n_val FROM (SELECT family, count(*) AS n FROM ({CORE}) GROUP BY 1))")
def b14_split_sizes(t: Tables) -> DataFrame:
    n = core(t).groupBy("family").agg(F.count("*").alias("n"))
    train, val, test = S.split_sizes(F.col("n"))
    return n.select("family", "n", train.alias("n_train"), val.alias("n_val"), test.alias("n_test"))


@query(
    "b16_group_split",
    f"""WITH g AS (SELECT question_id, row_number() OVER (ORDER BY md5('42|' || question_id), question_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT question_id FROM core_records WHERE question_id IS NOT NULL)),
k AS (SELECT *, {_TRAIN} AS a, {_VAL} AS v FROM g)
SELECT c.core_row_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + v THEN 'val' ELSE 'test' END AS new_split FROM core_records c JOIN k USING (question_id)""",
)
def b16_group_split(t: Tables) -> DataFrame:
    """Questions, not rows, are split, so that pairs stay together."""
    return S.group_split(t("core_records").where("question_id is not null"), "question_id", 42).select("core_row_id", "new_split")


@query("b17_eval_slice", "SELECT core_row_id, CASE WHEN coalesce(contains(lower(origin_model), 'claude'), false) THEN 'test_claude_holdout' WHEN " + SPLIT + " = 'test' THEN 'test_seen' ELSE " + SPLIT + " END AS slice FROM core_records")
def b17_eval_slice(t: Tables) -> DataFrame:
    from corpusloom.operators.records import held_out

    s = split_norm()
    return t("core_records").select("core_row_id", F.when(held_out(F.col("origin_model")), "test_claude_holdout").when(s == "test", "test_seen").otherwise(s).alias("slice"))


@query(
    "b20_two_pools",
    f"""WITH r AS (SELECT core_row_id, time_band, row_number() OVER (PARTITION BY time_band ORDER BY md5('5|' || core_row_id), core_row_id) AS r FROM core_records WHERE time_band IN ('legacy', 'modern')),
a AS (SELECT core_row_id FROM r WHERE time_band = 'legacy' AND r <= 60), n AS (SELECT 120 - count(*) AS k FROM a)
SELECT core_row_id FROM a UNION ALL SELECT core_row_id FROM r, n WHERE time_band = 'modern' AND r <= k""",
)
def b20_two_pools(t: Tables) -> DataFrame:
    """Half of 120 from the legacy pool, the rest topped up from the modern one."""
    return S.two_pools(t("core_records").where("time_band in ('legacy', 'modern')").select("core_row_id", "time_band"), "time_band", "legacy", 60, 120, "core_row_id", 5).select("core_row_id")


@query(
    "b21_cover_then_fill",
    f"""WITH r AS (SELECT core_row_id, family, bin, row_number() OVER (PARTITION BY family ORDER BY md5('9|' || core_row_id), core_row_id) AS f, row_number() OVER (PARTITION BY family, bin ORDER BY md5('9|' || core_row_id), core_row_id) AS s FROM ({CORE}))
SELECT core_row_id, CASE WHEN f = 1 THEN 0 WHEN s = 1 THEN 1 ELSE 2 END AS phase FROM r ORDER BY phase, md5('9|' || core_row_id), core_row_id LIMIT 60""",
)
def b21_cover_then_fill(t: Tables) -> DataFrame:
    """60 rows: every family, then every stratum, then any, in seeded order.

    First rows of families and strata are minima, so no partition is ranked."""
    return S.cover_then_fill(core(t).select("core_row_id", "family", "bin"), ["family"], ["family", "bin"], 60, "core_row_id", 9)


def sample_sql(src: str, n: str, keys: list[str], seed: int, key: str = "core_row_id") -> str:
    """Keys of a stratified sample of n rows by largest remainders."""
    by = ", ".join(keys)
    return f"""SELECT {key} FROM (SELECT {key}, {by}, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}|' || {key}), {key}) AS r FROM {src}) JOIN (
 SELECT {by}, least(cnt, CAST(floor(e) AS BIGINT) + CASE WHEN place <= rem THEN 1 ELSE 0 END) AS quota FROM (
 SELECT *, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, {by}) AS place, {n} - sum(floor(e)) OVER () AS rem FROM (
 SELECT *, {n} * cnt / CAST(sum(cnt) OVER () AS DOUBLE) AS e FROM (SELECT {by}, count(*) AS cnt FROM {src} GROUP BY {by})))) USING ({by}) WHERE r <= quota"""


@query("b8_merge_relabel", "SELECT core_row_id, label, CASE WHEN label = 0 THEN 'human' ELSE 'llm' END AS label_str FROM core_records WHERE label IN (0, 1)")
def b8_merge_relabel(t: Tables) -> DataFrame:
    """Groups are merged, relabelled, and their helper column is dropped."""
    r = t("core_records").where("label in (0, 1)").select("core_row_id", "label")
    parts = [r.where(F.col("label") == n).withColumn("_group", F.lit(g)) for n, g in ((0, "A"), (1, "B"))]
    return J.union_all(*parts).withColumn("label_str", F.when(F.col("label") == 0, "human").otherwise("llm")).drop("_group")


_PAIRS = """(SELECT c.question_id, coalesce(lower(trim(c.length_bin)), '') AS bin FROM core_records c JOIN (SELECT question_id FROM core_records WHERE question_id IS NOT NULL AND label IN (0, 1) GROUP BY 1
 HAVING count(*) FILTER (WHERE label = 0) = 1 AND count(*) FILTER (WHERE label = 1) = 1) USING (question_id) WHERE c.label = 0)"""


@query("b13_pair_sample", f"SELECT core_row_id FROM core_records WHERE label IN (0, 1) AND question_id IN ({sample_sql(_PAIRS, '800', ['bin'], 7, 'question_id')})")
def b13_pair_sample(t: Tables) -> DataFrame:
    """Up to 800 complete question pairs, stratified by the human side's bin."""
    r = t("core_records").where("label in (0, 1)")
    pairs = J.complete_pairs(r, "question_id", F.col("label") == 0)
    human = r.where("label = 0").join(pairs, "question_id").select("question_id", F.coalesce(F.lower(F.trim("length_bin")), F.lit("")).alias("bin"))
    return r.join(S.downsample(human, 800, ["bin"], "question_id", 7).select("question_id"), "question_id", "left_semi").select("core_row_id")


_CORE = f"(SELECT core_row_id, coalesce(family, '') AS family, coalesce(bin, '') AS bin FROM ({CORE}))"
_N = "(SELECT count(*) FROM core_records)"


@query(
    "b15_nested_split",
    f"""WITH a AS ({sample_sql(_CORE, f"CAST(floor({_N} * 0.75e0) AS BIGINT)", ['family', 'bin'], 42)}), rest AS (SELECT * FROM {_CORE} WHERE core_row_id NOT IN (SELECT core_row_id FROM a)),
v AS ({sample_sql('rest', f"CAST(floor({_N} * 0.15e0) AS BIGINT)", ['family', 'bin'], 43)})
SELECT core_row_id, CASE WHEN core_row_id IN (SELECT core_row_id FROM a) THEN 'train' WHEN core_row_id IN (SELECT core_row_id FROM v) THEN 'val' ELSE 'test' END AS new_split FROM core_records""",
)
def b15_nested_split(t: Tables) -> DataFrame:
    """Train is drawn first, val from what is left, test is the remainder."""
    r = core(t).select("core_row_id", F.coalesce("family", F.lit("")).alias("family"), F.coalesce("bin", F.lit("")).alias("bin"))
    return S.nested_split(r, ["family", "bin"], "core_row_id", 0.75, 0.15, 42)


@query("b19_stratified_or_random", f"SELECT 'strata' AS way, core_row_id FROM ({sample_sql(_CORE, '200', ['family'], 42)}) UNION ALL SELECT 'random', core_row_id FROM (SELECT core_row_id FROM core_records ORDER BY md5('42|' || core_row_id), core_row_id LIMIT 200)")
def b19_stratified_or_random(t: Tables) -> DataFrame:
    """By strata where each has two rows; plainly random where one has not."""
    r = core(t).select("core_row_id", F.coalesce("family", F.lit("")).alias("family"))
    a, b = S.stratified_or_random(r, 200, ["family"], "core_row_id", 42), S.stratified_or_random(r, 200, ["core_row_id"], "core_row_id", 42)
    return a.select(F.lit("strata").alias("way"), "core_row_id").unionByName(b.select(F.lit("random").alias("way"), "core_row_id"))


@query("b22_freeze_once", "SELECT doc_id FROM documents ORDER BY md5('11|' || doc_id), doc_id LIMIT 50")
def b22_freeze_once(t: Tables) -> DataFrame:
    """The second call, with another seed, gets the sample that the first one wrote."""
    path = remove_at_exit(t.spark, shared_folder(t.spark, "b22"))
    draw = lambda seed: t("documents").select("doc_id").orderBy(*J.seeded(seed, F.col("doc_id"))).limit(50)
    S.ensure_sample(t.spark, path, lambda: draw(11))
    return S.ensure_sample(t.spark, path, lambda: draw(12))


_POOL = "list_filter(['short', 'medium', 'long'], lambda b: b <> lower(length_bin))"


@query(
    "b24_generation_grid",
    f"""WITH g AS (SELECT target_id, target_permille AS n, least(12, CASE lower(channel) WHEN 'sms' THEN 12 WHEN 'email' THEN 5 ELSE 4 END) AS size, [lower(length_bin)] || {_POOL} AS pool FROM sample_targets),
k AS (SELECT *, unnest(range(0, CAST(ceil(n / CAST(size AS DOUBLE)) AS BIGINT))) AS batch FROM g)
SELECT target_id, batch, least(size, n - size * batch) AS size, pool[1 + batch % len(pool)] AS bin FROM k""",
)
def b24_generation_grid(t: Tables) -> DataFrame:
    """Jobs of at most the channel's size, each with the next bin of its cell's pool,
    the wanted bin first."""
    c = F.lower("channel")
    size = F.when(c == "sms", 12).when(c == "email", 5).otherwise(4)
    own = F.lower("length_bin")
    pool = F.concat(F.array(own), F.filter(F.array(F.lit("short"), F.lit("medium"), F.lit("long")), lambda b: b != own))
    n = F.ceil(F.col("target_permille") / size).cast("long")
    g = t("sample_targets").select("target_id", "target_permille", size.alias("s"), pool.alias("pool"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("batch"))
    return g.select("target_id", "batch", F.least("s", F.col("target_permille") - F.col("s") * F.col("batch")).alias("size"), F.get("pool", (F.col("batch") % F.size("pool")).cast("int")).alias("bin"))


@query("b23_simple_sample", "SELECT doc_id FROM documents ORDER BY md5('11|' || doc_id), doc_id LIMIT 50")
def b23_simple_sample(t: Tables) -> DataFrame:
    return t("documents").select("doc_id").orderBy(*J.seeded(11, F.col("doc_id"))).limit(50)


@query(
    "s21_job_grid",
    "SELECT target_id, unnest(range(0, CAST(ceil(target_permille / 25.0e0) AS BIGINT))) AS batch, least(25, target_permille - 25 * unnest(range(0, CAST(ceil(target_permille / 25.0e0) AS BIGINT)))) AS size FROM sample_targets",
)
def s21_job_grid(t: Tables) -> DataFrame:
    """Deterministic job grid: every cell's quota in batches of at most 25."""
    n = F.ceil(F.col("target_permille") / F.lit(25.0)).cast("long")
    g = t("sample_targets").select("target_id", "target_permille", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("batch"))
    return g.select("target_id", "batch", F.least(F.lit(25), F.col("target_permille") - 25 * F.col("batch")).alias("size"))
