"""Problem 1: garbled text from a wrong character encoding.

Each source is read as enciphered by a mixture of unknown code-page swaps: a
swap is a substitution of bytes by the characters of some code page. For every
distinct run of characters beyond ASCII, with its left and right neighbour
class, expectation-maximisation weighs the readings "plain" and "page p turned
these bytes into this" by letter frequencies, by language bigrams (neighbour
class and letter) and by the share of each swap in the source. Known pages only
start it: EM also estimates, per source, how likely each byte stands behind each
character, and this learned table is a swap of its own, which takes in characters
that no page has. All parameters are sums over the whole corpus; their number is
bounded by pages x letters x classes, so they are the only thing that reaches the
driver. Tables are applied with ``translate`` (character to byte) followed by
strict UTF-8 decoding, again and again, in any order of pages, until nothing
changes any more.

Defined results: null and empty texts are no case and stay as they are;
U+FFFD marks a character that was lost, which is a case and cannot be restored;
repeated rows are records of their own.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut, spread, table

#: ASCII-transparent single-byte code pages that may have been
#: mistaken for UTF-8 (the key space of the cipher).
PAGES = (
    "cp1252 latin-1 cp1250 cp1251 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-7 "
    "iso8859-9 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 cp437 cp850 cp852 cp855 cp858 cp866 cp857 mac-roman mac-latin2 mac-cyrillic koi8-r koi8-u"
).split()
RUN = regex.compile(r"[^\x00-\x7f]+")
LOST = "�"
ITERATIONS = 5
#: Expected sightings that a byte behind a character needs to enter a learned table.
LEAST_SEEN = 3.0


@lru_cache(maxsize=None)
def page_table(page: str) -> dict[int, int]:
    """Character to byte of a page; bytes the page leaves out stand for the
    control character of the same number, as decoders commonly pass them."""
    out: dict[int, int] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), b)
    return out


@lru_cache(maxsize=None)
def start_table() -> dict[int, int]:
    """What a learned table starts from: the two commonest pages together."""
    return page_table("latin-1") | page_table("cp1252")


def decoded(run: str, to_bytes: dict[int, int]) -> str | None:
    """The run read back through a table, if its bytes are strict UTF-8."""
    if any(ord(c) not in to_bytes for c in run):
        return None
    as_latin = run.translate(to_bytes)  # the substitution
    try:
        return as_latin.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return None


@lru_cache(maxsize=200_000)
def readings(run: str) -> tuple[tuple[str, str], ...]:
    """(swap, letters) of every way to read a run; the first is "plain". Layers are
    undone in any order of pages until none can be; each makes the run shorter."""
    best, level = {run: "plain"}, [("", run)]
    while level:
        nxt = []
        for name, text in level:
            for page in PAGES:
                got = decoded(text, page_table(page))
                # Pages that agree on these bytes are one reading.
                if got is not None and got not in best and LOST not in got:
                    best[got] = f"{name}+{page}" if name else page
                    if not got.isascii():
                        nxt.append((best[got], got))
        level = nxt
    return tuple((swap, text) for text, swap in best.items())


def learned_readings(run: str, table: dict[int, int]) -> list[tuple[str, str, str, int]]:
    """(swap, letters, character, byte) by a learned table; a character that it lacks
    may stand for any byte (then it is named with its byte)."""
    unknown = {c for c in run if ord(c) not in table}
    if len(unknown) > 1 or len(run) < 2:
        return []
    if not unknown:
        got = decoded(run, table)
        return [("learned", got, "", 0)] if got is not None and LOST not in got else []
    c = unknown.pop()
    ways = ((decoded(run, table | {ord(c): b}), b) for b in range(0x80, 0x100))
    return [("learned", got, c, b) for got, b in ways if got is not None and LOST not in got]


def klass(c: str) -> str:
    """Neighbour class for the bigrams."""
    if not c:
        return "^"
    if c.isalpha():
        return "U" if c.isupper() else "l"
    return "9" if c.isdigit() else "_" if c.isspace() else "."


def rarity(c: str) -> float:
    """Log weight of a letter before anything is learned: European letters,
    typographic signs and currency are usual, other blocks rare, control
    characters and symbols hardly ever text."""
    o = ord(c)
    if 0x80 <= o < 0xA0 or c == LOST:
        return math.log(1e-9)
    if c in "’‘“”–—…€£°«»":
        return math.log(0.02)
    if 0xC0 <= o < 0x180 and c.isalpha():
        return math.log(0.01 if c.islower() else 0.003)
    if c.isalpha():
        return math.log(3e-4 if 0x370 <= o < 0x530 else 3e-5)
    return math.log(3e-4 if o < 0x100 else 3e-5)


class Model:
    """Counts that EM learned: swaps per source, letters, bigrams."""

    def __init__(self, swaps: dict, letters: dict, left: dict, right: dict, total: float, bytes_: dict | None = None):
        self.swaps, self.letters, self.left, self.right, self.total = swaps, letters, left, right, total
        self.tables: dict[str, dict[int, int]] = {}  # source to the likeliest byte of each character
        for src, seen in (bytes_ or {}).items():
            top: dict[int, tuple[float, int]] = {}
            for (c, b), w in seen.items():
                top[ord(c)] = max(top.get(ord(c), (0.0, 0)), (w, b))
            self.tables[src] = start_table() | {c: b for c, (w, b) in top.items() if w >= LEAST_SEEN}

    def table(self, src: str) -> dict[int, int]:
        return self.tables.get(src) or start_table()

    def letter(self, c: str) -> float:
        if c < "\x80":
            return math.log(0.05)
        seen = self.letters.get(c, 0.0)
        return math.log((seen + 50 * math.exp(rarity(c))) / (self.total + 50)) if self.total else rarity(c)

    def bigram(self, side: dict, k: str, c: str) -> float:
        """log P(class | letter), smoothed to uniform over six classes."""
        return math.log((side.get((k, c), 0.0) + 1.0) / (self.letters.get(c, 0.0) + 6.0))

    def swap(self, src: str, name: str) -> float:
        got = self.swaps.get(src)
        if not got:
            return math.log(0.9 if name == "plain" else 0.1 / len(PAGES))
        return math.log((got.get(name, 0.0) + 0.05) / (sum(got.values()) + 0.05 * (len(PAGES) + 1)))

    def score(self, src: str, swap: str, text: str, l: str, r: str) -> float:
        s = self.swap(src, swap) + self.bigram(self.left, l, text[0]) + self.bigram(self.right, r, text[-1])
        s += sum(self.letter(c) for c in text)
        for a, b in zip(text, text[1:]):
            s += self.bigram(self.right, klass(b), a)
        return s

    def posterior(self, src: str, run: str, l: str, r: str) -> list[tuple[float, str, str, str, int]]:
        """(probability, swap, letters, character, byte) of each reading, best first."""
        ways = [(*w, "", 0) for w in readings(run)]
        known = {w[1] for w in ways}
        ways += [w for w in learned_readings(run, self.table(src)) if w[1] not in known]
        if len(ways) == 1:
            return [(1.0, *ways[0])]
        scores = [self.score(src, w[0], w[1], l, r) - (math.log(128) if w[2] else 0.0) for w in ways]
        top = max(scores)
        weights = [math.exp(s - top) for s in scores]
        z = sum(weights)
        return sorted(((w / z, *way) for w, way in zip(weights, ways)), reverse=True)


EMPTY = Model({}, {}, {}, {}, 0.0)


def contexts(records: DataFrame) -> DataFrame:
    """(src, run, l, r, n): runs beyond ASCII with their neighbour classes,
    counted before the shuffle and over all records."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: dict = defaultdict(int)
            for src, t in zip(pdf["src"], pdf["text"]):
                for m in RUN.finditer(t):
                    a, b = m.span()
                    n[(src, m.group(), klass(t[a - 1 : a]), klass(t[b : b + 1]))] += 1
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["src", "run", "l", "r", "n"])

    odd = records.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("src", "text")
    return odd.mapInPandas(go, "src string, run string, l string, r string, n long").groupBy("src", "run", "l", "r").agg(F.sum("n").alias("n"))


def learn(seen: DataFrame, iterations: int = ITERATIONS) -> Model:
    """EM over the counted contexts; only bounded sums come back."""
    model = EMPTY
    for _ in range(iterations):

        def expect(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            sums: dict = defaultdict(float)
            for pdf in batches:
                for src, run, l, r, n in zip(pdf["src"], pdf["run"], pdf["l"], pdf["r"], pdf["n"]):
                    for p, swap, text, c, byte in model.posterior(src, run, l, r):
                        if p < 1e-6:
                            continue
                        w = p * n
                        sums[("swap", src, swap)] += w
                        if c:
                            sums[("byte", src, f"{c}{byte:02x}")] += w
                        elif swap not in ("plain", "learned"):
                            table_ = page_table(swap.split("+")[0])
                            for x in set(run):
                                sums[("byte", src, f"{x}{table_[ord(x)]:02x}")] += w
                        elif swap == "learned":
                            for x in set(run):
                                sums[("byte", src, f"{x}{model.table(src)[ord(x)]:02x}")] += w
                        # Letters far from European text share one bucket, so the parameters stay bounded.
                        cs = [c if rarity(c) > -9 else "\U000f0000" for c in text]
                        ks = [l, *map(klass, text), r]
                        for i, c in enumerate(cs):
                            if c >= "\x80":
                                sums[("letter", "", c)] += w
                                sums[("left", ks[i], c)] += w
                                sums[("right", ks[i + 2], c)] += w
            yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["part", "a", "b", "w"])

        got = seen.mapInPandas(expect, "part string, a string, b string, w double").groupBy("part", "a", "b").agg(F.sum("w").alias("w")).collect()
        swaps: dict = defaultdict(dict)
        letters, left, right = {}, {}, {}
        bytes_: dict = defaultdict(dict)
        for x in got:
            if x.part == "swap":
                swaps[x.a][x.b] = x.w
            elif x.part == "letter":
                letters[x.b] = x.w
            elif x.part == "byte":
                bytes_[x.a][x.b[0], int(x.b[1:], 16)] = x.w
            else:
                (left if x.part == "left" else right)[(x.a, x.b)] = x.w
        model = Model(dict(swaps), letters, left, right, sum(letters.values()), dict(bytes_))
    return model


def restore_text(model: Model, src: str, text: str | None) -> tuple[str | None, bool, bool]:
    """(restored, garbled, lost)."""
    if text is None or text.isascii():
        return text, False, False
    out, at, hit = [], 0, False
    for m in RUN.finditer(text):
        a, b = m.span()
        run = m.group()
        best = model.posterior(src, run, klass(text[a - 1 : a]), klass(text[b : b + 1]))[0]
        out += [text[at:a], best[2]]
        hit |= best[1] != "plain"
        at = b
    out.append(text[at:])
    lost = LOST in text
    return "".join(out), hit or lost, lost


def restore(records: DataFrame) -> DataFrame:
    """src, rec_id, text, restored, garbled, lost: one row per input row.

    ``records`` has src, rec_id and text. Rows of plain ASCII stay in the JVM."""
    odd = F.coalesce(F.col("text").rlike(r"[^\x00-\x7f]"), F.lit(False))
    model = learn(cut(contexts(records)))
    plain = records.where(~odd).select("src", "rec_id", "text", F.col("text").alias("restored"), F.lit(False).alias("garbled"), F.lit(False).alias("lost"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [restore_text(model, s, t) for s, t in zip(pdf["src"], pdf["text"])]
            pdf["restored"], pdf["garbled"], pdf["lost"] = [x[0] for x in got], [x[1] for x in got], [x[2] for x in got]
            yield pdf

    done = records.where(odd).select("src", "rec_id", "text").mapInPandas(go, "src string, rec_id bigint, text string, restored string, garbled boolean, lost boolean")
    return plain.unionByName(done)


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "enron_ham_annotated").select(F.lit("enron_ham_annotated").alias("src"), F.col("rec_id").cast("bigint").alias("rec_id"), "text")
    b = table(spark, sf_dir, "nigerian_fraud_prepared").select(F.lit("nigerian_fraud_prepared").alias("src"), F.col("rec_id").cast("bigint").alias("rec_id"), F.col("raw_body").alias("text"))
    return spread(a.unionByName(b))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with garbled or lost characters."""
    return restore(mails(spark, sf_dir)).where("garbled").select("src", "rec_id")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected records with the text as its sender wrote it."""
    return restore(mails(spark, sf_dir)).where("garbled").select("src", "rec_id", F.col("restored").alias("text"), "lost")
