"""Problem 8: evaluation texts leaking into training text.

One Aho-Corasick automaton over the normalised evaluation passages scans every
document once. Words are encoded as one character each (words that no passage
uses share a sentinel), so a match is a run of whole words and its position
maps back to character offsets of the original text. Any ``window`` consecutive
words of an item hold one of its anchors, ``(window + 1) // 2`` words taken at every
such distance; the automaton finds anchors, and a found anchor is extended in both
directions to the whole common passage. Items shorter than the window are anchors
as a whole. That needs about one node a word instead of one a word and window
place.

The automaton is built once in each executor process. The evaluation side is
taken in blocks of at most :data:`BLOCK_WORDS` words, so one automaton has a
proven size however much evaluation material there is; the corpus is scanned once
a block and never shuffled.

Defined results: null or empty documents and items match nothing; an item
without any word matches nothing; items with equal text each get their row;
repeated documents are documents of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textform as tf
from corpusloom.session import spread, table

WINDOW = 15
#: Words of evaluation text in one automaton (about 100 bytes each, and fewer
#: different words than there are characters to encode them).
BLOCK_WORDS = 1_000_000
_FIRST, _SENTINEL = 0x100, "\x01"


def normal_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) with offsets into the text as given."""
    return [(m.group().casefold(), *m.span()) for m in tf.WORD.finditer(text)]


class Passages:
    """The automaton of one block: anchors lead to the items and places they stand at."""

    def __init__(self, items: tuple[tuple[int, str], ...], window: int):
        self.window, self.step = window, (window + 1) // 2
        self.code: dict[str, str] = {}
        self.items: list[tuple[int, str]] = []
        anchors: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            words = "".join(self.code.setdefault(w, self._char()) for w, _, _ in normal_words(text))
            if not words:
                continue
            at = len(self.items)
            self.items.append((item, words))
            if len(words) < window:
                anchors.setdefault(words, []).append((at, 0))
                continue
            # Any 2 * step - 1 words hold a whole step.
            for p in range(0, len(words) - self.step + 1, self.step):
                anchors.setdefault(words[p : p + self.step], []).append((at, p))
        self.auto = ahocorasick.Automaton()
        for anchor, places in anchors.items():
            self.auto.add_word(anchor, (len(anchor), places))
        self.auto.make_automaton()

    def _char(self) -> str:
        n = _FIRST + len(self.code)
        return chr(n + (0x800 if n >= 0xD800 else 0))

    def scan(self, text: str) -> dict[int, tuple[int, int]]:
        """item -> (first, last) character offsets of its passages in the text."""
        out: dict[int, tuple[int, int]] = {}
        if not len(self.auto):
            return out
        words = normal_words(text)
        coded = "".join(self.code.get(w, _SENTINEL) for w, _, _ in words)
        done: dict[tuple[int, int], int] = {}  # (item, shift) -> end of the last passage
        for last, (size, places) in self.auto.iter(coded):
            q = last - size + 1
            for at, p in places:
                item, own = self.items[at]
                if done.get((at, q - p), -1) > last:
                    continue
                a, b = 0, size
                while a < min(p, q) and own[p - a - 1] == coded[q - a - 1]:
                    a += 1
                while p + b < len(own) and q + b < len(coded) and own[p + b] == coded[q + b]:
                    b += 1
                done[(at, q - p)] = q + b
                if a + b >= min(self.window, len(own)):
                    lo, hi = out.get(item, (words[q - a][1], words[q + b - 1][2]))
                    out[item] = (min(lo, words[q - a][1]), max(hi, words[q + b - 1][2]))
        return out


#: Automata of this process, by the name of their block.
_built: dict[str, Passages] = {}


def passages(name: str, items: tuple[tuple[int, str], ...], window: int) -> Passages:
    if name not in _built:
        _built.clear()
        _built[name] = Passages(items, window)
    return _built[name]


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[tuple[int, str], ...]]:
    """The evaluation set in blocks of bounded size, fetched one at a time."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in items.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len(normal_words(r.text))
        if part and size + n > block_words:
            yield tuple(part)
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += n
    if part:
        yield tuple(part)


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, start, end of every leaked item."""
    schema = "doc_id bigint, item_id bigint, start int, end int"
    docs = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    sc = documents.sparkSession.sparkContext
    for block in blocks(items):

        def go(batches: Iterator[pd.DataFrame], name: str = uuid.uuid4().hex, shipped: object = sc.broadcast(block)) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = passages(name, shipped.value, window)
                rows = [(d, i, a, b) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, (a, b) in found.scan(t).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end"])

        part = docs.mapInPandas(go, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], schema)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the evaluation items it leaks."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the character range of the passages."""
    return _leaks(spark, sf_dir)
