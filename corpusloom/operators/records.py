"""Record shaping, predicates and classification by rules (Columns and frames)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make_record(text: Column, **constants: object) -> list[Column]:
    """A record's columns: text, constants, length in characters."""
    return [text.alias("text"), *(F.lit(v).alias(k) for k, v in constants.items()), F.length(text).alias("char_length")]


def drop_private(df: DataFrame, prefix: str = "_") -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in df.columns if not c.startswith(prefix)])


def keep(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The wanted columns that are there, in the order asked for."""
    return df.select([F.col(f"`{c}`") for c in wanted if c in df.columns])


def nest(df: DataFrame, **groups: list[str]) -> DataFrame:
    """Gather columns into named structs; the others stay."""
    inside = {c for g in groups.values() for c in g}
    return df.select(*[c for c in df.columns if c not in inside], *(F.struct(*g).alias(n) for n, g in groups.items()))


def unnest(df: DataFrame, *structs: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in structs], *(F.col(f"{s}.*") for s in structs))


def lookup(c: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """Value of a small constant mapping."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(pairs[c], F.lit(default)) if default is not None else pairs[c]


def any_of(c: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs, without regard to case; null is no."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """Name of the first rule that holds."""
    out = None
    for name, test in rules:
        out = F.when(F.coalesce(test, F.lit(False)), name) if out is None else out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise(default)


def one_of(c: Column, allowed: Iterable[str], default: str) -> Column:
    """Clamp to an enumeration, read without regard to case and outer blanks."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(*allowed), v).otherwise(default)


def held_out(model: Column, word: str = "claude") -> Column:
    """Texts of the generator kept out of training; null is no."""
    return F.lower(F.coalesce(model, F.lit(""))).contains(word)


def quadrant(label: Column, fraud: Column) -> Column:
    """Two-by-two group: human or generated, legitimate or fraud."""
    f = F.lower(F.trim(fraud))
    return (
        F.when((label == 0) & (f == "legitimate"), "A").when((label == 0) & (f == "fraud"), "B").when((label == 1) & (f == "legitimate"), "C").when((label == 1) & (f == "fraud"), "D").otherwise("?")
    )
