"""Queries over data-quality checks (V)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import checks as C
from corpusloom.operators.joins import union_all
from corpusloom.operators.records import held_out
from corpusloom.plans.q_aggregates import CORE, core
from corpusloom.plans.q_text import TOKENS, sql_bin
from corpusloom.plans.registry import Tables, query

FAMILIES = ["phishing_email", "advance_fee_scam_email", "fraud_sms_deceptive", "legitimate_email", "legitimate_sms", "financial_qa"]
_IN = "(" + ", ".join(f"'{f}'" for f in FAMILIES) + ")"
_HELD = "coalesce(contains(lower(origin_model), 'claude'), false)"
_BIN = sql_bin(TOKENS)

RULES = [
    ("required_fields", "error", "label IS NULL OR split IS NULL OR source_family IS NULL"),
    ("no_empty_text", "error", "coalesce(trim(text), '') = ''"),
    ("llm_has_model", "error", "label = 1 AND origin_model IS NULL"),
    ("held_out_only_in_test", "error", f"{_HELD} AND split <> 'test'"),
    ("split_domain", "error", "split NOT IN ('train', 'val', 'test')"),
    ("family_domain", "warning", f"family NOT IN {_IN}"),
    ("channel_domain", "warning", "channel NOT IN ('email', 'sms', 'qa')"),
    ("label_agrees", "error", "(label = 0) <> (label_str = 'human')"),
    ("sms_is_short", "warning", "channel = 'sms' AND bin = 'long'"),
    ("length_bin_agrees", "warning", f"bin <> {_BIN}"),
    ("char_length_agrees", "warning", "char_length <> length(text)"),
    ("human_without_model", "warning", "label = 0 AND origin_model IS NOT NULL AND origin_model <> 'human'"),
    ("question_only_in_qa", "warning", "question_id IS NOT NULL AND family <> 'financial_qa'"),
    ("has_provenance", "warning", "provenance_source_file IS NULL OR provenance_line_no IS NULL"),
]


@query("v1_row_checks", f"WITH r AS ({CORE}) " + " UNION ALL ".join(f"SELECT '{n}' AS name, '{s}' AS severity, count(*) FILTER (WHERE {b}) AS n_bad, count(*) FILTER (WHERE {b}) = 0 AS ok FROM r" for n, s, b in RULES))
def v1_row_checks(t: Tables) -> DataFrame:
    """All row rules of the assembled corpus in one pass."""
    held, bin_now = held_out(F.col("origin_model")), X.length_bin(X.token_count(F.col("text")), F.col("channel"))
    bad = {
        "required_fields": F.expr("label IS NULL OR split IS NULL OR source_family IS NULL"),
        "held_out_only_in_test": held & (F.col("split") != "test"),
        "length_bin_agrees": F.col("bin") != bin_now,
    }
    rules = [(n, s, bad.get(n) if n in bad else F.expr(b.replace('"', ""))) for n, s, b in RULES]
    return C.row_checks(core(t), rules)


@query(
    "v2_table_checks",
    f"""WITH r AS ({CORE})
SELECT 'no_shared_text' AS name, 'error' AS severity, count(*) AS n_bad, count(*) = 0 AS ok FROM (SELECT md5(text) FROM r WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'no_duplicate_text', 'warning', count(*), count(*) = 0 FROM (SELECT md5(text) FROM r WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unique_ids', 'error', count(*), count(*) = 0 FROM (SELECT core_row_id FROM r GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'complete_pairs', 'warning', count(*), count(*) = 0 FROM (SELECT question_id FROM r WHERE question_id IS NOT NULL GROUP BY 1 HAVING NOT (count(*) FILTER (WHERE label = 0) = 1 AND count(*) FILTER (WHERE label = 1) = 1))
UNION ALL SELECT 'source_share', 'warning', count(*), count(*) = 0 FROM (SELECT source_family FROM r GROUP BY 1 HAVING count(*) > 0.35e0 * (SELECT count(*) FROM r))
UNION ALL SELECT 'label_balance', 'warning', count(*), count(*) = 0 FROM (SELECT split FROM r GROUP BY 1 HAVING abs(avg(CAST(label AS DOUBLE)) - 0.5e0) > 0.1e0)
UNION ALL SELECT 'both_labels_per_family', 'error', count(*), count(*) = 0 FROM (SELECT family FROM r WHERE family IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) < 2)
UNION ALL SELECT 'channel_audit', 'warning', count(*), count(*) = 0 FROM (SELECT channel, split FROM r WHERE channel IS NOT NULL GROUP BY 1, 2 HAVING (count(*) FILTER (WHERE label = 0) > 50 AND count(*) FILTER (WHERE label = 1) = 0) OR (count(*) FILTER (WHERE label = 1) > 50 AND count(*) FILTER (WHERE label = 0) = 0))""",
)
def v2_table_checks(t: Tables) -> DataFrame:
    r = core(t)
    some = r.where("text is not null").groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    total = r.agg(F.count("*").alias("t"))
    n1, n0 = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    pairs = r.where("question_id is not null").groupBy("question_id").agg(n0.alias("h"), n1.alias("l"))
    return union_all(
        C.table_check("no_shared_text", "error", some.where("a != b")),
        C.table_check("no_duplicate_text", "warning", some.where("n > 1")),
        C.table_check("unique_ids", "error", r.groupBy("core_row_id").agg(F.count("*").alias("n")).where("n > 1")),
        C.table_check("complete_pairs", "warning", pairs.where("not (h = 1 and l = 1)")),
        C.table_check("source_share", "warning", r.groupBy("source_family").agg(F.count("*").alias("n")).join(F.broadcast(total)).where("n > 0.35D * t")),
        C.table_check("label_balance", "warning", r.groupBy("split").agg(F.avg("label").alias("m")).where("abs(m - 0.5D) > 0.1D")),
        C.table_check("both_labels_per_family", "error", r.where("family is not null").groupBy("family").agg(F.count_distinct("label").alias("n")).where("n < 2")),
        C.table_check("channel_audit", "warning", r.where("channel is not null").groupBy("channel", "split").agg(n0.alias("h"), n1.alias("l")).where("(h > 50 and l = 0) or (l > 50 and h = 0)")),
    )


@query(
    "v27_match_checks",
    f"""WITH r AS ({CORE}), f AS (SELECT family, count(*) FILTER (WHERE label = 1 AND {_HELD}) AS held, count(*) FILTER (WHERE label = 0 AND split = 'test') AS reserve FROM r WHERE family IS NOT NULL GROUP BY 1)
SELECT family, held, reserve, least(held, reserve) AS pairs, CASE WHEN reserve = 0 THEN 'no human reserve' WHEN reserve < held THEN 'fewer humans than held-out texts' ELSE '' END AS shortfall FROM f""",
)
def v27_match_checks(t: Tables) -> DataFrame:
    """How many matched pairs each family can have, and why not more."""
    r = core(t).where("family is not null")
    f = r.groupBy("family").agg(F.count_if((F.col("label") == 1) & held_out(F.col("origin_model"))).alias("held"), F.count_if((F.col("label") == 0) & (F.col("split") == "test")).alias("reserve"))
    why = F.when(F.col("reserve") == 0, "no human reserve").when(F.col("reserve") < F.col("held"), "fewer humans than held-out texts").otherwise("")
    return f.select("family", "held", "reserve", F.least("held", "reserve").alias("pairs"), why.alias("shortfall"))


_ISS = "list_filter([CASE WHEN label IS NULL THEN 'no_label' END, CASE WHEN scenario_family IS NULL THEN 'no_family' END, CASE WHEN channel IS NULL THEN 'no_channel' END, CASE WHEN text IS NULL THEN 'no_text' END], lambda x: x IS NOT NULL)"


@query("v31_issue_strings", f"SELECT array_to_string({_ISS}, ',') AS issues, count(*) AS n FROM core_records GROUP BY 1")
def v31_issue_strings(t: Tables) -> DataFrame:
    c = X.issues(("no_label", F.col("label").isNull()), ("no_family", F.col("scenario_family").isNull()), ("no_channel", F.col("channel").isNull()), ("no_text", F.col("text").isNull()))
    return t("core_records").groupBy(F.array_join(c, ",").alias("issues")).agg(F.count("*").alias("n"))


@query("v32_length_bin_drift", f"SELECT bin, {_BIN} AS recomputed, count(*) AS n FROM ({CORE}) GROUP BY 1, 2")
def v32_length_bin_drift(t: Tables) -> DataFrame:
    return core(t).groupBy("bin", X.length_bin(X.token_count(F.col("text")), F.col("channel")).alias("recomputed")).agg(F.count("*").alias("n"))
