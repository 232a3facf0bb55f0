"""Flagship: profile of the message corpus, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.plans.q_text import SQL_CHANNEL, TOKENS, channel_norm, sql_bin, sql_collapse
from corpusloom.plans.registry import Tables, query

_MASK = r"regexp_replace(text, '(?i)https?://\S+|www\.\S+', '[URL]', 'g')"


@query(
    "corpus_profile",
    f"""WITH m AS (SELECT doc_id, source, channel, {sql_collapse(_MASK)} AS text FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM m WHERE text <> '')
SELECT source, coalesce({sql_bin(TOKENS, SQL_CHANNEL)}, '(none)') AS length_bin, count(*) AS n_docs, CAST(sum({TOKENS}) AS BIGINT) AS n_tokens
FROM k WHERE rn = 1 GROUP BY 1, 2""",
)
def corpus_profile(t: Tables) -> DataFrame:
    """Mask, collapse, keep the first of equal texts, count by source and length.

    The first copy is found by a minimum per text key, which combines on the map
    side; a text copied into a third of all rows is no hot task."""
    m = t("documents").where("text is not null").select("doc_id", "source", "channel", X.mask_collapsed(F.col("text")).alias("text")).where("text != ''")
    first = m.groupBy(F.md5("text").alias("k")).agg(F.min(F.struct("doc_id", "source", "channel", "text")).alias("r")).select("r.*")
    n = X.token_count(F.col("text"))
    return first.groupBy("source", F.coalesce(X.length_bin(n, channel_norm()), F.lit("(none)")).alias("length_bin")).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"))


