"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import leaks, lookalikes, mailparts, mixture, mojibake, overlap, pairs, pii, quota_sample, truncated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": mojibake.p1_found,
    "p1_restored": mojibake.p1_restored,
    "p2_found": overlap.p2_found,
    "p2_report": overlap.p2_report,
    "p3_found": quota_sample.p3_found,
    "p3_sample": quota_sample.p3_sample,
    "p3_report": quota_sample.p3_report,
    "p4_found": pii.p4_found,
    "p4_redacted": pii.p4_redacted,
    "p5_found": pairs.p5_found,
    "p6_found": mailparts.p6_found,
    "p6_authored": mailparts.p6_authored,
    "p7_found": lookalikes.p7_found,
    "p7_unified": lookalikes.p7_unified,
    "p8_found": leaks.p8_found,
    "p8_passages": leaks.p8_passages,
    "p9_mixture": mixture.p9_mixture,
    "p9_shares": mixture.p9_shares,
    "p10_found": truncated.p10_found,
    "p10_rates": truncated.p10_rates,
}

_CELL = " || '|' || ".join(f"regexp_replace(lower({c}), '[\\s_\\-]+', '', 'g')" for c in ("scenario_family", "channel", "length_bin"))
_CELLS = f"""
WITH eligible AS (
  SELECT {_CELL} AS cell FROM core_records
  WHERE scenario_family IS NOT NULL AND channel IS NOT NULL AND length_bin IS NOT NULL
), n AS (SELECT count(*) // 5 AS n FROM eligible),
cells AS (SELECT cell, count(*) AS n_eligible FROM eligible GROUP BY cell),
t AS (
  SELECT target_id, {_CELL} AS cell,
    greatest(CAST(min_rows AS BIGINT), (CAST(target_permille AS BIGINT) * (SELECT n FROM n)) // 1000) AS required
  FROM sample_targets
)
"""
_WORDS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w))"

ORACLES: dict[str, str] = {
    "p3_found": _CELLS
    + """
SELECT target_id FROM t LEFT JOIN cells USING (cell) WHERE coalesce(n_eligible, 0) < required""",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
p AS (
  SELECT item_id, array_to_string(w[k : k + 14], ' ') AS phrase, 15 AS size
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS k FROM i WHERE len(w) >= 15)
  UNION
  SELECT item_id, array_to_string(w, ' '), len(w) FROM i WHERE len(w) BETWEEN 1 AND 14
),
sizes AS (SELECT DISTINCT size FROM p),
g AS (
  SELECT doc_id, array_to_string(w[k : k + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)
)
SELECT DISTINCT doc_id, item_id FROM g JOIN p USING (phrase)""",
}
