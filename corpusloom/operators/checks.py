"""Data-quality checks: one row a check (name, severity, n_bad, ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(Exception):
    """A check of severity ``error`` does not hold."""


def row_checks(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Counts the rows that break each rule, all rules in one pass. A rule's column
    is true for a bad row; null is not bad."""
    cells = [F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_bad")).alias(f"c{i}") for i, (n, s, bad) in enumerate(rules)]
    r = df.agg(*cells).select(F.explode(F.array(*(f"c{i}" for i in range(len(rules))))).alias("c")).select("c.*")
    return r.withColumn("ok", F.col("n_bad") == 0)


def table_check(name: str, severity: str, bad: DataFrame) -> DataFrame:
    """A check that fails with every row of ``bad``."""
    return bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), "n_bad", (F.col("n_bad") == 0).alias("ok"))


def enforce(results: DataFrame, strict: bool = False) -> DataFrame:
    """Raise if an error (or, if strict, a warning) fails; the table of checks is
    as long as the list of checks."""
    levels = ["error", "warning"] if strict else ["error"]
    bad = results.where((~F.col("ok")) & F.col("severity").isin(levels)).collect()
    if bad:
        raise CheckFailed("; ".join(f"{r['name']}: {r['n_bad']}" for r in bad))
    return results
