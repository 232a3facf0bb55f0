"""Problem 7: visually identical text with different characters.

Word runs that hold an unusual character are matched against tries of the
corpus's own plain vocabulary by a weighted edit automaton in which a look-alike
letter, a styled form, a split accent and an ignorable character cost nothing,
a second reading of a letter costs a little and an edit costs one. The cheapest,
then the most frequent word is the canonical spelling. Runs that no vocabulary
word matches within :data:`LIMIT` are normalised by table.

Scale: words and runs meet under a skeleton that folds every group of readings
to one letter, so no reading is lost. The vocabulary is pre-aggregated and
reduced to the skeletons of unusual runs; each skeleton has a trie of its own,
built where its runs are, and nothing goes to the driver. A run that very many
rows hold is joined by broadcast (few runs can be that frequent).

Defined results: a null text stays null and is no case; an empty text is
unchanged; repeated rows are records of their own; columns beyond the named
ones are carried through untouched, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textform as tf
from corpusloom.llm.overlap import join_hot
from corpusloom.session import cut, spread, table

#: JVM test for text that may need work.
UNUSUAL = r"[^\t\n\r\x20-\x7e]"
#: Greatest cost of a match: second readings, but no edit.
LIMIT = 0.99
#: Cost of a letter's second reading.
SECOND = 0.25


# ---- weighted edit automaton over a trie ------------------------------------

class Trie:
    """Vocabulary trie; words carry their corpus counts."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + count

    def match(self, run: str, limit: float = LIMIT) -> list[tuple[float, int, str]]:
        """(cost, -count, word) of every vocabulary word within ``limit``."""
        units = _units(run)
        live = [(self.root, "", 0.0)]
        for ways in units:
            nxt: dict[int, tuple] = {}
            for node, word, cost in live:
                for out, price in ways.items():
                    to, ok = node, True
                    for c in out:
                        to = to.get(c)
                        if to is None:
                            ok = False
                            break
                    total = cost + price
                    if ok and total <= limit and (id(to) not in nxt or nxt[id(to)][2] > total):
                        nxt[id(to)] = (to, word + out, total)
                if cost + 1 <= limit:
                    for c, to in node.items():
                        if c and (id(to) not in nxt or nxt[id(to)][2] > cost + 1):
                            nxt[id(to)] = (to, word + c, cost + 1)
            live = list(nxt.values())
            if not live:
                return []
        return sorted((cost, -node[""], word) for node, word, cost in live if "" in node)


#: Second Latin readings of look-alike letters, by their shape.
ALSO = {"і": "l", "І": "l", "ι": "l", "Ι": "l", "Ӏ": "l", "υ": "v", "т": "m"}
#: Latin letters and digits that are readings of one shape, and the
#: letter that stands for the group in a skeleton.
FOLD = {"i": "l", "I": "l", "1": "l", "u": "v", "m": "t"}


def _units(run: str) -> list[dict[str, float]]:
    """Each input unit with the outputs it may stand for and their costs."""
    units: list[dict[str, float]] = []
    latin = bool(tf.LATIN.search("".join(tf.styled(c) or c for c in run)))
    for c in run:
        if tf.INVISIBLE.match(c):
            units.append({"": 0.0})
        elif unicodedata.combining(c) and units:
            units[-1] = {unicodedata.normalize("NFC", o + c): p for o, p in units[-1].items()}
        else:
            plain = tf.styled(c) or c
            if latin and plain in tf.LOOKALIKE:
                units.append({tf.LOOKALIKE[plain]: 0.0} | ({ALSO[plain]: SECOND} if plain in ALSO else {}))
            else:
                units.append({plain: 0.0})
    return units


def skeleton(word: str) -> str:
    """Key under which a run and all its readings meet."""
    return tf.plain_run(word).translate(_FOLD)


_FOLD = str.maketrans(FOLD)


# ---- distributed part --------------------------------------------------------

def unusual(piece: str) -> bool:
    return not piece.isascii() and tf.plain_run(piece) != piece


def vocabulary(records: DataFrame, text: str) -> DataFrame:
    """(word, n, key) of all word runs of all texts, counted in the JVM."""
    word = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("word")
    return records.select(word).groupBy("word").agg(F.count("*").alias("n")).withColumn("key", F.translate("word", "".join(FOLD), "".join(FOLD.values())))


def canonical_spellings(runs: DataFrame, records: DataFrame, text: str, limit: float = LIMIT) -> DataFrame:
    """(run, word, by_trie): the chosen spelling of every distinct run of ``runs``
    (run, key, freq)."""
    words = vocabulary(records, text).join(runs.select("key").distinct(), "key", "left_semi")
    # The words of one skeleton look alike, so their list is short.
    lists = words.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    met = runs.join(lists, "key", "left").select("key", "run", "freq", "words")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, trie = None, Trie()
        for pdf in batches:
            out = []
            for key, run, freq, words in zip(pdf["key"], pdf["run"], pdf["freq"], pdf["words"]):
                if key != at:
                    at, trie = key, Trie()
                    for w in words if words is not None else ():
                        if not unusual(w["word"]):
                            trie.add(w["word"], int(w["n"]))
                found = trie.match(run, limit)
                out.append((run, found[0][2] if found else tf.plain_run(run), bool(found), freq))
            yield pd.DataFrame(out, columns=["run", "word", "by_trie", "freq"])

    return met.mapInPandas(match, "run string, word string, by_trie boolean, freq long")


def unify(records: DataFrame, keys: list[str], text: str, limit: float = LIMIT) -> DataFrame:
    """``keys``, ``text`` in one form, and ``changed``; one row per input row.

    Plain rows never leave the JVM. Rows with unusual characters get the
    spellings of their own runs by an equi-join on the run."""
    data = records.select(*keys, text)
    flag = F.coalesce(F.col(text).rlike(UNUSUAL), F.lit(False))
    plain = data.where(~flag).withColumn("changed", F.lit(False))
    odd = data.where(flag)
    kinds = [f"`{k}` {data.schema[k].dataType.simpleString()}" for k in keys]

    def runs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sorted({p for k, p in tf.pieces(t) if k == "run" and unusual(p)}) for t in pdf.iloc[:, -1]]
            out = pdf.iloc[:, :-1].assign(run=found).explode("run", ignore_index=True).dropna(subset=["run"])
            # Typed, as a batch may hold unusual characters but no unusual run.
            yield out.assign(key=pd.Series([skeleton(r) for r in out["run"]], index=out.index, dtype=object))

    asked = cut(odd.mapInPandas(runs_of, ", ".join([*kinds, "run string", "key string"])))
    runs = asked.groupBy("run", "key").agg(F.count("*").alias("freq"))
    spell = cut(canonical_spellings(runs, records, text, limit))
    total = spell.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]

    @F.pandas_udf("string")
    def rewrite(s: pd.Series, table_: pd.Series) -> pd.Series:
        return pd.Series([tf.canonical(t, {x["run"]: x["word"] for x in (w if w is not None else ())}) for t, w in zip(s, table_)], dtype=object)

    given = join_hot(asked.drop("key"), spell.select("run", "word", "freq"), "run", "freq", total).groupBy(*keys).agg(F.collect_set(F.struct("run", "word")).alias("_table"))
    done = odd.join(given, keys, "left").withColumn("_new", rewrite(F.col(text), F.col("_table")))
    done = done.select(*keys, F.col("_new").alias(text), (F.col("_new") != F.col(text)).alias("changed"))
    return plain.unionByName(done)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "smishtank_prepared").select(F.lit("smishtank_prepared").alias("src"), F.col("rec_id").cast("bigint").alias("row_key"), "text")
    b = table(spark, sf_dir, "core_records").select(F.lit("core_records").alias("src"), F.col("core_row_id").cast("bigint").alias("row_key"), "text")
    return spread(a.unionByName(b))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text had to change to reach the one form."""
    return unify(_records(spark, sf_dir), ["src", "row_key"], "text").where("changed").select("src", "row_key")


def p7_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of both tables in one form."""
    return unify(_records(spark, sf_dir), ["src", "row_key"], "text")
