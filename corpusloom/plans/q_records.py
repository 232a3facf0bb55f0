"""Queries over record shaping and predicates (P) and joins (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import joins as J
from corpusloom.operators import records as R
from corpusloom.operators.windows import ordinal
from corpusloom.plans.q_text import FINGER, SQL_CHANNEL, TOKENS, channel_norm, fingerprint, q, sql_bin
from corpusloom.plans.registry import Tables, query

FAMILY = "regexp_replace(lower(trim({c})), '[- ]', '_', 'g')"


def family(c: str = "scenario_family"):  # noqa: ANN201 - Column
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


SPLIT = "lower(trim(split))"


def split_norm():  # noqa: ANN201 - Column
    return F.lower(F.trim("split"))


@query("proj1_make_record", "SELECT rec_id, text, 'smishing' AS content_type, 'smishtank' AS dataset_source, CAST(length(text) AS INTEGER) AS char_length FROM smishtank_prepared")
def proj1_make_record(t: Tables) -> DataFrame:
    return t("smishtank_prepared").select("rec_id", *R.make_record(F.col("text"), content_type="smishing", dataset_source="smishtank"))


@query("proj2_flat_annotation", "SELECT rec_id, text, category, coalesce(annotation_confidence, 'low') AS annotation_confidence, annotation_model FROM enron_ham_annotated")
def proj2_flat_annotation(t: Tables) -> DataFrame:
    """Columns that start with ``_`` are dropped, extras kept."""
    r = t("enron_ham_annotated").select("rec_id", "text", "category", F.coalesce("annotation_confidence", F.lit("low")).alias("annotation_confidence"), "annotation_model", F.lit(1).alias("_cursor"))
    return R.drop_private(r)


@query("proj3_nest_and_flatten", "SELECT rec_id, text, subject, category, annotation_model FROM enron_ham_annotated")
def proj3_nest_and_flatten(t: Tables) -> DataFrame:
    """To the nested cache form and back."""
    r = t("enron_ham_annotated").select("rec_id", "text", "subject", "category", "annotation_model")
    return R.unnest(R.nest(r, raw=["text", "subject"], annotation=["category", "annotation_model"]), "raw", "annotation")


LANES = {"openai/gpt-4o-mini": "llm_seen_openai", "mistral/mistral-small": "llm_seen_mistral"}
_LANE_SQL = "CASE origin_model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANES.items()) + " ELSE 'llm_holdout_claude' END"


@query("proj4_enrich_generated", f"SELECT gen_id, {_LANE_SQL} AS source_family, coalesce(actual_bin, {sql_bin(TOKENS)}) AS length_bin, 'modern' AS time_band FROM llm_mass_generation")
def proj4_enrich_generated(t: Tables) -> DataFrame:
    """Lane from the model, bin inferred where it is missing."""
    inferred = X.length_bin(X.token_count(F.col("text")), F.col("channel"))
    return t("llm_mass_generation").select("gen_id", R.lookup(F.col("origin_model"), LANES, "llm_holdout_claude").alias("source_family"), F.coalesce("actual_bin", inferred).alias("length_bin"), F.lit("modern").alias("time_band"))


@query(
    "proj5_quadrant",
    """SELECT CASE WHEN label = 0 AND f = 'legitimate' THEN 'A' WHEN label = 0 AND f = 'fraud' THEN 'B' WHEN label = 1 AND f = 'legitimate' THEN 'C' WHEN label = 1 AND f = 'fraud' THEN 'D' ELSE '?' END AS quadrant, count(*) AS n
 FROM (SELECT label, lower(trim(fraudness)) AS f FROM core_records) GROUP BY 1""",
)
def proj5_quadrant(t: Tables) -> DataFrame:
    return t("core_records").groupBy(R.quadrant(F.col("label"), F.col("fraudness")).alias("quadrant")).agg(F.count("*").alias("n"))


@query("proj6_decode", f"SELECT core_row_id, CASE label WHEN 0 THEN 'human' WHEN 1 THEN 'llm' END AS decoded, CAST(label AS DOUBLE) AS y, {SPLIT} AS split FROM core_records")
def proj6_decode(t: Tables) -> DataFrame:
    return t("core_records").select("core_row_id", F.when(F.col("label") == 0, "human").when(F.col("label") == 1, "llm").alias("decoded"), F.col("label").cast("double").alias("y"), split_norm().alias("split"))


SUBTYPES = {"delivery": "delivery_fee", "bank": "account_alert", "prize": "prize_or_contest", "account": "account_alert"}
_SUB = "CASE lower(trim(message_categories)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUBTYPES.items()) + " ELSE 'other' END"


@query("proj7_category_lookup", f"SELECT rec_id, {_SUB} AS subtype, CASE WHEN {_SUB} = 'other' THEN 'review' ELSE 'yes' END AS keep FROM smishtank_prepared")
def proj7_category_lookup(t: Tables) -> DataFrame:
    sub = R.lookup(F.lower(F.trim("message_categories")), SUBTYPES, "other")
    return t("smishtank_prepared").select("rec_id", sub.alias("subtype"), F.when(sub == "other", "review").otherwise("yes").alias("keep"))


@query("proj8_yes_no", "SELECT rec_id, CASE WHEN coalesce(has_url, false) THEN 'yes' ELSE 'no' END AS url FROM enron_ham_annotated")
def proj8_yes_no(t: Tables) -> DataFrame:
    return t("enron_ham_annotated").select("rec_id", X.yes_no(F.col("has_url")).alias("url"))


@query("proj9_time_band", f"SELECT rec_id, CASE WHEN CAST(nullif(regexp_extract(coalesce(date_raw, ''), {q(X.YEAR)}, 1), '') AS INTEGER) >= 2015 THEN 'modern' ELSE 'legacy' END AS time_band FROM enron_ham_annotated")
def proj9_time_band(t: Tables) -> DataFrame:
    return t("enron_ham_annotated").select("rec_id", F.when(X.first_year(F.col("date_raw")) >= 2015, "modern").otherwise("legacy").alias("time_band"))


@query("proj10_time_band_prefix", "SELECT DISTINCT dataset_source, CASE WHEN starts_with(dataset_source, 'llm_') THEN 'modern' ELSE 'legacy' END AS time_band FROM core_records")
def proj10_time_band_prefix(t: Tables) -> DataFrame:
    return t("core_records").select("dataset_source", F.when(F.startswith("dataset_source", F.lit("llm_")), "modern").otherwise("legacy").alias("time_band")).distinct()


@query("proj11_held_out", "SELECT core_row_id FROM core_records WHERE contains(lower(coalesce(origin_model, '')), 'claude')")
def proj11_held_out(t: Tables) -> DataFrame:
    return t("core_records").where(R.held_out(F.col("origin_model"))).select("core_row_id")


@query("proj12_human_only", "SELECT dataset_source, count(*) FILTER (WHERE ok) AS n_kept, count(*) FILTER (WHERE NOT ok) AS n_dropped FROM (SELECT dataset_source, coalesce(label = 0 AND label_str = 'human', false) AS ok FROM core_records) GROUP BY 1")
def proj12_human_only(t: Tables) -> DataFrame:
    ok = F.coalesce((F.col("label") == 0) & (F.col("label_str") == "human"), F.lit(False))
    return t("core_records").groupBy("dataset_source").agg(F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_dropped"))


@query("proj13_length_gates", f"SELECT core_row_id FROM core_records WHERE length(text) >= 50 AND {TOKENS} <= 5000")
def proj13_length_gates(t: Tables) -> DataFrame:
    return t("core_records").where((F.length("text") >= 50) & (X.token_count(F.col("text")) <= 5000)).select("core_row_id")


@query("proj14_language_gate", "SELECT doc_id FROM documents WHERE lang = 'en' AND length(trim(text)) >= 15")
def proj14_language_gate(t: Tables) -> DataFrame:
    return t("documents").where("lang = 'en' and length(trim(text)) >= 15").select("doc_id")


@query("proj16_not_blank", r"SELECT rec_id FROM enron_ham_annotated WHERE regexp_replace(text, '\s', '', 'g') <> ''")
def proj16_not_blank(t: Tables) -> DataFrame:
    return t("enron_ham_annotated").where(F.regexp_replace("text", r"\s", "") != "").select("rec_id")


@query("proj17_first_per_question", "SELECT question_id, min(core_row_id) AS core_row_id FROM core_records WHERE question_id IS NOT NULL GROUP BY 1")
def proj17_first_per_question(t: Tables) -> DataFrame:
    return t("core_records").where("question_id is not null").groupBy("question_id").agg(F.min("core_row_id").alias("core_row_id"))


@query("proj18_keep_list", "SELECT core_row_id, label, split FROM core_records")
def proj18_keep_list(t: Tables) -> DataFrame:
    return R.keep(t("core_records"), ["core_row_id", "label", "absent_column", "split"])


@query("proj19_truthy", "SELECT rec_id, lower(trim(coalesce(has_url, ''))) NOT IN ('', '0', '0.0', 'no', 'false', 'none', 'n') AS flag FROM smishtank_prepared")
def proj19_truthy(t: Tables) -> DataFrame:
    return t("smishtank_prepared").select("rec_id", X.truthy(F.col("has_url")).alias("flag"))


MONEY, MEETING = ["invoice", "refund", "deposit", "payment"], ["meeting", "room", "discussion", "agenda"]


def _sql_any(ws: list[str], c: str = "text") -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in ws) + ")"


@query("proj20_any_keyword", f"SELECT doc_id FROM documents WHERE {_sql_any(MONEY)}")
def proj20_any_keyword(t: Tables) -> DataFrame:
    return t("documents").where(R.any_of(F.col("text"), MONEY)).select("doc_id")


@query("proj21_first_match", f"SELECT doc_id, CASE WHEN coalesce(length(text), 0) < 20 THEN 'too_short' WHEN {_sql_any(MONEY)} THEN 'money' WHEN {_sql_any(MEETING)} THEN 'meeting' ELSE 'other' END AS theme FROM documents")
def proj21_first_match(t: Tables) -> DataFrame:
    c = F.col("text")
    rules = [("too_short", F.coalesce(F.length(c), F.lit(0)) < 20), ("money", R.any_of(c, MONEY)), ("meeting", R.any_of(c, MEETING))]
    return t("documents").select("doc_id", R.first_match(rules, "other").alias("theme"))


@query("proj22_flag_rates", f"SELECT source, round(avg(CAST({_sql_any(MONEY)} AS INTEGER)), 6) AS money, round(avg(CAST({_sql_any(MEETING)} AS INTEGER)), 6) AS meeting FROM documents GROUP BY 1")
def proj22_flag_rates(t: Tables) -> DataFrame:
    rate = lambda ws: F.round(F.avg(R.any_of(F.col("text"), ws).cast("int")), 6)
    return t("documents").groupBy("source").agg(rate(MONEY).alias("money"), rate(MEETING).alias("meeting"))


@query("proj23_clamp", "SELECT rec_id, CASE WHEN lower(trim(annotation_confidence)) IN ('high', 'medium', 'low') THEN lower(trim(annotation_confidence)) ELSE 'low' END AS confidence FROM mendeley_smishing_prepared")
def proj23_clamp(t: Tables) -> DataFrame:
    return t("mendeley_smishing_prepared").select("rec_id", R.one_of(F.col("annotation_confidence"), ["high", "medium", "low"], "low").alias("confidence"))


@query("proj24_include_counts", "SELECT coalesce(core_keep_for_dataset1, '(none)') AS policy, count(*) AS n, count(*) FILTER (WHERE sms_fraud_subtype IS NULL) AS n_no_subtype FROM smishtank_prepared GROUP BY 1")
def proj24_include_counts(t: Tables) -> DataFrame:
    return t("smishtank_prepared").groupBy(F.coalesce("core_keep_for_dataset1", F.lit("(none)")).alias("policy")).agg(F.count("*").alias("n"), F.count_if(F.col("sms_fraud_subtype").isNull()).alias("n_no_subtype"))


# ---- joins ------------------------------------------------------------------------


@query("j1_pending", "SELECT rec_id FROM smishtank_prepared WHERE md5(trim(coalesce(text, ''))) NOT IN (SELECT md5(trim(coalesce(text, ''))) FROM core_records)")
def j1_pending(t: Tables) -> DataFrame:
    a = t("smishtank_prepared").select("rec_id", X.md5_key(F.col("text")).alias("k"))
    return J.pending(a, t("core_records").select(X.md5_key(F.col("text")).alias("k")), "k").select("rec_id")


@query(
    "j2_annotation_lookup",
    "SELECT a.rec_id, b.label_str FROM (SELECT rec_id, md5(trim(text)) AS k FROM smishtank_prepared WHERE text IS NOT NULL) a JOIN (SELECT md5(trim(text)) AS k, min(label_str) AS label_str FROM smishtank_prepared WHERE text IS NOT NULL GROUP BY 1) b USING (k)",
)
def j2_annotation_lookup(t: Tables) -> DataFrame:
    r = t("smishtank_prepared").where("text is not null").select("rec_id", F.md5(F.trim("text")).alias("k"), "label_str")
    return r.select("rec_id", "k").join(r.groupBy("k").agg(F.min("label_str").alias("label_str")), "k").select("rec_id", "label_str")


@query("j3_score_merge", "SELECT c.core_row_id, g.gen_n FROM core_records c LEFT JOIN (SELECT origin_model, count(*) AS gen_n FROM llm_mass_generation GROUP BY 1) g USING (origin_model)")
def j3_score_merge(t: Tables) -> DataFrame:
    g = t("llm_mass_generation").groupBy("origin_model").agg(F.count("*").alias("gen_n"))
    return t("core_records").select("core_row_id", "origin_model").join(g, "origin_model", "left").select("core_row_id", "gen_n")


@query("j4_complete_pairs", "SELECT question_id FROM core_records WHERE question_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE label = 0) = 1 AND count(*) FILTER (WHERE label = 1) = 1")
def j4_complete_pairs(t: Tables) -> DataFrame:
    return J.complete_pairs(t("core_records").where("label in (0, 1)"), "question_id", F.col("label") == 0)


@query(
    "j5_pair_sets",
    "SELECT sides, count(*) AS n FROM (SELECT question_id, CASE WHEN bool_or(label = 0) AND bool_or(label = 1) THEN 'both' WHEN bool_or(label = 0) THEN 'left' ELSE 'right' END AS sides FROM core_records WHERE question_id IS NOT NULL AND label IN (0, 1) GROUP BY 1) GROUP BY 1",
)
def j5_pair_sets(t: Tables) -> DataFrame:
    return J.key_sides(t("core_records").where("label in (0, 1)"), "question_id", F.col("label") == 0).groupBy("sides").agg(F.count("*").alias("n"))


@query("j6_reserve", f"SELECT core_row_id FROM (SELECT core_row_id, {FINGER} AS f, label FROM core_records) WHERE label = 0 AND f NOT IN (SELECT {FINGER} FROM core_records WHERE {SPLIT} = 'train' AND label = 0)")
def j6_reserve(t: Tables) -> DataFrame:
    r = t("core_records").where("label = 0").select("core_row_id", fingerprint().alias("f"), split_norm().alias("s"))
    return J.pending(r, r.where("s = 'train'").select("f"), "f").select("core_row_id")


@query(
    "j7_split_leakage",
    f"""WITH d AS (SELECT DISTINCT sha256(trim(coalesce(text, ''))) AS k, {SPLIT} AS s FROM core_records WHERE text IS NOT NULL)
SELECT a.s AS split_a, b.s AS split_b, count(*) AS n_shared FROM d a JOIN d b USING (k) WHERE a.s < b.s GROUP BY 1, 2""",
)
def j7_split_leakage(t: Tables) -> DataFrame:
    return J.split_leakage(t("core_records").where("text is not null"), X.sha_key(F.col("text")), split_norm())


_TIER = [["family", "channel", "fraudness", "length_bin", "time_band"], ["family", "channel", "fraudness", "length_bin"], ["family", "channel", "fraudness"]]


def _tier_sql() -> str:
    base = f"SELECT core_row_id, label, {FAMILY.format(c='scenario_family')} AS family, {SQL_CHANNEL} AS channel, fraudness, lower(trim(length_bin)) AS length_bin, time_band, coalesce(contains(lower(origin_model), 'claude'), false) AS held FROM core_records"
    sql, outs = f"WITH r AS ({base}), l0 AS (SELECT * FROM r WHERE label = 1 AND held), g0 AS (SELECT * FROM r WHERE label = 0)", []
    for n, cols in enumerate(_TIER):
        keys, some = ", ".join(cols), " AND ".join(f"{c} IS NOT NULL" for c in cols)
        num = f"row_number() OVER (PARTITION BY {keys} ORDER BY md5('42|' || core_row_id), core_row_id) AS n"
        sql += f", h{n} AS (SELECT a.core_row_id AS left_id, b.core_row_id AS right_id, {n} AS tier FROM (SELECT *, {num} FROM l{n} WHERE {some}) a JOIN (SELECT *, {num} FROM g{n} WHERE {some}) b USING ({keys}, n))"
        sql += f", l{n + 1} AS (SELECT * FROM l{n} WHERE core_row_id NOT IN (SELECT left_id FROM h{n})), g{n + 1} AS (SELECT * FROM g{n} WHERE core_row_id NOT IN (SELECT right_id FROM h{n}))"
        outs.append(f"SELECT * FROM h{n}")
    return sql + " " + " UNION ALL ".join(outs)


def tier_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    r = t("core_records").select("core_row_id", "label", family().alias("family"), channel_norm().alias("channel"), "fraudness", F.lower(F.trim("length_bin")).alias("length_bin"), "time_band", R.held_out(F.col("origin_model")).alias("held"))
    return r.where("label = 1 and held"), r.where("label = 0")


@query("j8_tiered_match", _tier_sql())
def j8_tiered_match(t: Tables) -> DataFrame:
    """Held-out texts matched to human ones, tier after tier, none used twice."""
    held, human = tier_sides(t)
    return J.match_tiers(held, human, "core_row_id", _TIER)


_SET = "WITH m AS (SELECT * FROM (" + _tier_sql() + f")), h AS (SELECT core_row_id, {FAMILY.format(c='scenario_family')} AS family, coalesce(contains(lower(origin_model), 'claude'), false) AS held, label FROM core_records)"


@query(
    "b18_companion_report",
    _SET
    + """ SELECT family, CAST(count(*) AS BIGINT) AS n_held, count(tier) AS n_matched, count(*) FILTER (WHERE tier = 0) AS n_tier0, count(*) FILTER (WHERE tier = 1) AS n_tier1, count(*) FILTER (WHERE tier = 2) AS n_tier2,
 CASE WHEN count(tier) = count(*) THEN 'none' WHEN count(tier) = 0 THEN 'no human text' ELSE 'too few human texts' END AS shortfall, count(*) FILTER (WHERE tier <= 1) >= 0.5e0 * count(tier) AS half_tier_0_or_1
 FROM h LEFT JOIN m ON m.left_id = h.core_row_id WHERE held AND label = 1 GROUP BY 1""",
)
def b18_companion_report(t: Tables) -> DataFrame:
    """Per family: held-out texts, their human companions by tier, why some have none,
    and whether at least half were matched in the two best tiers."""
    held, human = tier_sides(t)
    m = J.match_tiers(held, human, "core_row_id", _TIER).select(F.col("left_id").alias("core_row_id"), "tier")
    g = held.select("core_row_id", "family").join(m, "core_row_id", "left").groupBy("family")
    n, k = F.count("*"), F.count("tier")
    why = F.when(k == n, "none").when(k == 0, "no human text").otherwise("too few human texts")
    tier = lambda i: F.count_if(F.col("tier") == i).alias(f"n_tier{i}")
    return g.agg(n.alias("n_held"), k.alias("n_matched"), tier(0), tier(1), tier(2), why.alias("shortfall"), (F.count_if(F.col("tier") <= 1) >= F.lit(0.5) * k).alias("half_tier_0_or_1"))


@query("b18_companion_set", _SET + " SELECT core_row_id, 1 AS label, tier FROM h JOIN m ON m.left_id = core_row_id UNION ALL SELECT right_id, 0, tier FROM m")
def b18_companion_set(t: Tables) -> DataFrame:
    """The balanced set: held-out texts and their human companions."""
    m = J.match_tiers(*tier_sides(t), "core_row_id", _TIER)
    side = lambda c, n: m.select(F.col(c).alias("core_row_id"), F.lit(n).alias("label"), "tier")
    return side("left_id", 1).unionByName(side("right_id", 0))


@query(
    "j9_nearest_length",
    """WITH p AS (SELECT row_number() OVER (ORDER BY gen_id) AS p, 0 AS z, channel, fraudness, length(text) AS s FROM llm_mass_generation WHERE text IS NOT NULL AND channel IS NOT NULL AND fraudness IS NOT NULL),
pool AS (SELECT min(core_row_id) AS id, lower(trim(channel)) AS channel, fraudness, length(text) AS s FROM core_records WHERE label = 0 AND text IS NOT NULL AND channel IS NOT NULL AND fraudness IS NOT NULL GROUP BY 2, 3, 4),
c AS (SELECT p.p, pool.id, abs(pool.s - p.s) AS distance, row_number() OVER (PARTITION BY p.p ORDER BY abs(pool.s - p.s), pool.s, pool.id) AS rank FROM p JOIN pool USING (channel, fraudness))
SELECT p AS probe_id, id AS pool_id, distance, rank FROM c WHERE rank <= 2""",
)
def j9_nearest_length(t: Tables) -> DataFrame:
    """The two nearest lengths of human texts to every generated one, each with its
    first text; j9_nearest_texts does not leave out the other texts of a length."""
    some = t("llm_mass_generation").where("text is not null and channel is not null and fraudness is not null")
    probes = ordinal(some.select("gen_id", "channel", "fraudness", F.length("text").alias("s")), "gen_id", "p")
    pool = t("core_records").where("label = 0 and text is not null and channel is not null and fraudness is not null")
    pool = pool.groupBy(F.lower(F.trim("channel")).alias("channel"), "fraudness", F.length("text").alias("s")).agg(F.min("core_row_id").alias("id"))
    return J.nearest_by(probes, pool, ["channel", "fraudness"], "p", "id", "s", 2)


@query(
    "j9_nearest_texts",
    """WITH p AS (SELECT row_number() OVER (ORDER BY gen_id) AS p, lower(trim(channel)) AS channel, fraudness, length(text) AS s FROM llm_mass_generation WHERE text IS NOT NULL AND channel IS NOT NULL AND fraudness IS NOT NULL),
pool AS (SELECT min(core_row_id) AS id, lower(trim(channel)) AS channel, fraudness, text, length(text) AS s FROM core_records WHERE label = 0 AND text IS NOT NULL AND channel IS NOT NULL AND fraudness IS NOT NULL GROUP BY 2, 3, 4),
c AS (SELECT p.p, pool.id, abs(pool.s - p.s) AS distance, row_number() OVER (PARTITION BY p.p ORDER BY abs(pool.s - p.s), pool.s, pool.id) AS rank FROM p JOIN pool USING (channel, fraudness))
SELECT p AS probe_id, id AS pool_id, distance, rank FROM c WHERE rank <= 2""",
)
def j9_nearest_texts(t: Tables) -> DataFrame:
    """The two distinct human texts nearest in length to every generated one."""
    some = t("llm_mass_generation").where("text is not null and channel is not null and fraudness is not null")
    probes = ordinal(some.select("gen_id", F.lower(F.trim("channel")).alias("channel"), "fraudness", F.length("text").alias("s")), "gen_id", "p")
    pool = t("core_records").where("label = 0 and text is not null and channel is not null and fraudness is not null")
    pool = pool.groupBy(F.lower(F.trim("channel")).alias("channel"), "fraudness", "text").agg(F.min("core_row_id").alias("id"))
    return J.nearest_by(probes, pool.withColumn("s", F.length("text")), ["channel", "fraudness"], "p", "id", "s", 2)


@query("j10_paired_examples", "SELECT question_id, max(text) FILTER (WHERE label = 0) AS human, max(text) FILTER (WHERE label = 1) AS llm FROM core_records WHERE question_id IS NOT NULL GROUP BY 1")
def j10_paired_examples(t: Tables) -> DataFrame:
    r = t("core_records").where("question_id is not null").withColumn("role", F.when(F.col("label") == 0, "human").when(F.col("label") == 1, "llm"))
    return r.groupBy("question_id").pivot("role", ["human", "llm"]).agg(F.max("text"))


@query("j11_gap_fill", "SELECT rec_id FROM mendeley_smishing_prepared WHERE text IS NOT NULL AND sha256(trim(text)) NOT IN (SELECT sha256(trim(text)) FROM smishtank_prepared WHERE text IS NOT NULL)")
def j11_gap_fill(t: Tables) -> DataFrame:
    a = t("mendeley_smishing_prepared").where("text is not null").select("rec_id", F.sha2(F.trim("text"), 256).alias("k"))
    return J.pending(a, t("smishtank_prepared").where("text is not null").select(F.sha2(F.trim("text"), 256).alias("k")), "k").select("rec_id")


@query("j12_union_all", "SELECT rec_id, text, message_categories, NULL AS annotation_model FROM smishtank_prepared UNION ALL SELECT rec_id, text, NULL, annotation_model FROM mendeley_smishing_prepared")
def j12_union_all(t: Tables) -> DataFrame:
    return J.union_all(t("smishtank_prepared").select("rec_id", "text", "message_categories"), t("mendeley_smishing_prepared").select("rec_id", "text", "annotation_model"))


@query("j14_disjoint", f"SELECT count(*) AS n_shared FROM (SELECT DISTINCT {FINGER} AS f FROM core_records WHERE {SPLIT} = 'train') a JOIN (SELECT DISTINCT {FINGER} AS f FROM core_records WHERE {SPLIT} = 'test') b USING (f)")
def j14_disjoint(t: Tables) -> DataFrame:
    r = t("core_records").select(fingerprint().alias("f"), split_norm().alias("s"))
    return r.where("s = 'train'").select("f").distinct().join(r.where("s = 'test'").select("f"), "f", "left_semi").agg(F.count("*").alias("n_shared"))


@query("s19_semi_join", f"SELECT doc_id FROM documents WHERE source IN (SELECT source FROM source_weights WHERE contains(source, 'sms') OR contains(source, 'llm'))")
def s19_semi_join(t: Tables) -> DataFrame:
    w = t("source_weights").where("contains(source, 'sms') or contains(source, 'llm')").select("source")
    return t("documents").join(w, "source", "left_semi").select("doc_id")


