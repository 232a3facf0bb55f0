"""Problem 2: same or near-same records across splits.

Records are normalised (one form, no case, words only), cut into content-defined
chunks by a rolling hash over the words, and the digests of the chunks are
joined across splits; the lengths of shared chunks are summed into overlap
fractions. Pairs above a permissive fraction are checked exactly: the longest
common subsequence of words must reach 80 % of the longer text.

Scale and skew:

* Equal word sequences on one side form a class; only class representatives are
  chunked, compared and checked, and pairs are expanded by membership at the end.
* Every record offers only its rarest chunks, enough that any pair sharing the
  fraction ``share`` of its words must meet in one of them (prefix filtering), so
  boilerplate that fills a third of all rows is not joined at all.
* A chunk that is frequent even so is replaced by pairs of chunks: two records
  that share it and reach ``share`` also share a second one. Nothing is capped.
* In a short text few edits can leave no chunk whole. Texts of at most
  :data:`SHORT` words are therefore met under pairs of their rarest words: two
  texts with 80 % of their words in common share two of the first
  ``n - ceil(0.8 n) + 2`` (prefix filtering, exact for the threshold). A frequent
  pair is replaced by its triples, as the third shared word is one place later at most.
* A sketch of the words travels with all keys and drops pairs that cannot have 80 %
  in common before any pair is moved.
* Hot keys (a digest or a text that many rows hold) are few by arithmetic and are
  joined by broadcast; members of large classes are expanded in blocks.
* Lengths must be within 80 % of each other, which is part of the join.

Defined results: null texts and texts without words match nothing; the split is
read without regard to case and outer blanks, other splits take no part; copies
of a record each get their pairs; a record is never paired with itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textform as tf
from corpusloom.session import cut, discard, spread, table

THRESHOLD = 0.8
#: Least fraction of the longer text's words in shared chunks for a candidate.
SHARE = 0.15
#: A cut after about every seventh word; the window of the rolling hash is one word.
MEAN_CHUNK = 7
LONGEST_CHUNK = 16
#: Longest text (in words) that is met under pairs of words.
SHORT = 48
#: Shortest text that is met under chunks; shorter ones have no partner over SHORT.
LEAST = 39
#: Columns of a sketch of 256 bits of a text's words.
SKETCH = ["s0", "s1", "s2", "s3"]
#: Pairs that one chunk may propose before it is replaced by pairs of chunks.
HOT_PAIRS = 2_000
#: Keys that hold more than 1/WIDE of all rows are joined by broadcast.
WIDE = 5_000
#: Places of the table of word frequencies; words that share one count together.
PLACES = 1 << 18
#: Short texts on which the pairs of words are counted at least, and the least
#: sightings of a pair among them for it to be replaced by triples.
SAMPLE = 20_000
SEEN = 16
#: Odd factor that spreads the digest of a pair before the third word is added.
MIX = np.int64(-7046029254386353131)
#: Members of a class that are expanded in one block.
BLOCK = 10_000


_ASCII_WORDS = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    if text.isascii() and tf.PLAIN.match(text):
        return _ASCII_WORDS.findall(text.lower())
    return tf.words_of(tf.canonical(text))


@lru_cache(maxsize=200_000)
def word_hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word)


def cuts_after(word: str) -> bool:
    """Whether the rolling hash asks for a cut behind this word."""
    return word_hash(word) % MEAN_CHUNK == 0


def chunks(ws: list[str]) -> tuple[list[int], list[int]]:
    """(digests, words in each) of the content-defined chunks; repeats are kept
    apart by their ordinal."""
    ds: list[int] = []
    sizes: list[int] = []
    seen: dict[int, int] = {}
    start, n = 0, len(ws)
    for end in [i for i, h in enumerate(map(word_hash, ws), 1) if h % MEAN_CHUNK == 0 or i == n]:
        while start < end:
            stop = min(end, start + LONGEST_CHUNK)
            d = xxhash.xxh64_intdigest(" ".join(ws[start:stop]))
            k = seen[d] = seen.get(d, 0) + 1
            if k > 1:
                d = xxhash.xxh64_intdigest(f"{d}/{k}")
            ds.append(d - (1 << 63))
            sizes.append(stop - start)
            start = stop
    return ds, sizes


def word_digests(ws: list[str]) -> list[int]:
    """A digest a word; repeats are kept apart by their ordinal."""
    out = [h - (1 << 31) for h in map(word_hash, ws)]
    if len(set(ws)) < len(ws):
        seen: dict[str, int] = {}
        for i, w in enumerate(ws):
            k = seen[w] = seen.get(w, 0) + 1
            if k > 1:
                out[i] = xxhash.xxh32_intdigest(f"{w}/{k}") - (1 << 31)
    return out


def sketch(digests: list[int]) -> list[int]:
    """256 bits, one or more words each, as four numbers."""
    bits = np.zeros(256, np.uint8)
    bits[(np.array(digests, np.int64) >> 20) & 255] = 1
    return np.packbits(bits).view(np.int64).tolist()


_LONGS = ", ".join(f"{c} bigint" for c in SKETCH)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over words."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def near_same(a: list[str], b: list[str]) -> bool:
    """At least 80 % of the longer text's words, in order, in the other."""
    need = THRESHOLD * max(len(a), len(b))
    if min(len(a), len(b)) < need - 1e-9:
        return False
    # Words that the other text lacks are outside any common subsequence.
    there = set(b)
    if sum(w in there for w in a) < need - 1e-9:
        return False
    while a and b and a[0] == b[0]:  # common ends need no table
        a, b, need = a[1:], b[1:], need - 1
    while a and b and a[-1] == b[-1]:
        a, b, need = a[:-1], b[:-1], need - 1
    return need <= 1e-9 or (min(len(a), len(b)) >= need - 1e-9 and lcs(a, b) >= need - 1e-9)


def side(c: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.when(s == "train", F.lit(True)).when(s.isin("val", "test"), F.lit(False))


def prepare(records: DataFrame, key: str) -> DataFrame:
    """key, train, digest of side and words, n, chunks of longer texts (digest and words
    of each in one number), digests of the words of short texts, sketch."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, s, t in zip(pdf["key"], pdf["train"], pdf["text"]):
                ws = words(t)
                if ws:
                    n, v = len(ws), word_digests(ws)
                    c = [(d >> 8 << 8) | w for d, w in zip(*chunks(ws))] if n >= LEAST else None
                    h = xxhash.xxh3_128_digest(" ".join(ws)) + (b"t" if s else b"e")
                    rows.append((k, s, h, n, c, v if n <= SHORT else None, *(sketch(v) if c else [0] * 4)))
            yield pd.DataFrame(rows, columns=["key", "train", "h", "n", "c", "v", *SKETCH])

    src = records.select(F.col(key).cast("bigint").alias("key"), side(F.col("split")).alias("train"), "text").where("train is not null and text is not null")
    return src.mapInPandas(go, f"key bigint, train boolean, h binary, n int, c array<bigint>, v array<int>, {_LONGS}")


def join_hot(left: DataFrame, right: DataFrame, key: str, freq: str, total: int) -> DataFrame:
    """Inner join where few keys may hold most rows of ``left``. ``right`` has the
    key's rows in ``freq``; those with more than 1/WIDE of ``total`` rows (at most
    WIDE of them) are joined by broadcast, every other brings few rows to its task."""
    hot = F.broadcast(right.where(F.col(freq) > F.lit(total / WIDE)))
    rest = left.join(hot.select(key), key, "left_anti").join(right, key)
    return left.join(hot, key).unionByName(rest)


def offers(cls: DataFrame, share: float, hot_pairs: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, k1, k2, sketch) of the train and of the evaluation side: the keys under
    which a class of ``cls`` (id, train, n, c) can be met. k2 is 0, or the second chunk where k1 is too frequent
    alone."""
    cls = cls.where("c is not null")
    # Side and id in one number, digest and size in another: these are the most rows moved.
    who = F.shiftleft("id", 1).bitwiseOR(F.col("train").cast("long")).alias("who")
    rows = cls.select(who, F.explode("c").alias("x")).select("who", F.shiftright("x", 8).alias("d"), F.col("x").bitwiseAND(F.lit(255)).cast("byte").alias("w"))
    on_train = F.col("who").bitwiseAND(F.lit(1)) == 1
    # Both counts in one number: these rows are the next most moved.
    both_counts = F.sum(F.when(on_train, F.lit(1)).otherwise(F.lit(1 << 32))).alias("n")
    df = rows.groupBy("d").agg(both_counts).select("d", F.col("n").bitwiseAND(F.lit((1 << 32) - 1)).alias("dt"), F.shiftright("n", 32).alias("de"))
    # Chunks seen on one side only cannot meet, but their words count in the length.
    both = cut(df.where("dt > 0 and de > 0").select("d", (F.col("dt") + F.col("de")).alias("freq"), (F.col("dt") * F.col("de") > hot_pairs).alias("hot")))
    total = both.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    met = join_hot(rows, both, "d", "freq", total)
    met = met.groupBy("who").agg(F.array_sort(F.collect_list(F.struct("freq", "d", "w", "hot"))).alias("c"))
    met = met.select("who", F.col("c.d").alias("d"), F.col("c.w").alias("w"), F.col("c.hot").alias("hot")).join(cls.select(who, "n", *SKETCH), "who")
    # Records whose shared chunks cannot reach the fraction drop out in the JVM.
    flat = met.where(F.aggregate("w", F.lit(0), lambda a, x: a + x) >= F.lit(share) * F.col("n"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for who, n, ds, sizes, hots, *k in zip(*(pdf[x] for x in ["who", "n", "d", "w", "hot", *SKETCH])):
                i, need = who >> 1, share * n
                ds, sizes, hots = ds.tolist(), sizes.tolist(), hots.tolist()
                left = sum(sizes)
                for j, d in enumerate(ds):
                    if left < need:
                        break
                    if not hots[j] or sizes[j] >= need:
                        rows.append((i, n, d, 0, *k))
                    if hots[j]:
                        after = left - sizes[j]
                        for m in range(j + 1, len(ds)):
                            if after < need - sizes[j]:
                                break
                            rows.append((i, n, d, ds[m], *k))
                            after -= sizes[m]
                    left -= sizes[j]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["id", "n", "k1", "k2", *SKETCH])
                    rows = []
            yield pd.DataFrame(rows, columns=["id", "n", "k1", "k2", *SKETCH])

    one = lambda side_: flat.where(F.col("who").bitwiseAND(F.lit(1)) == side_).mapInPandas(go, f"id bigint, n int, k1 bigint, k2 bigint, {_LONGS}")
    return one(1), one(0)


def candidate_pairs(keys: tuple[DataFrame, DataFrame], cls: DataFrame, share: float) -> DataFrame:
    """Distinct (a, b): train and evaluation classes that meet under a key, may have
    80 % of their words in common and share chunks of at least ``share`` of the
    longer one's words."""
    one = lambda side_, i: side_.select("k1", "k2", F.col("id").alias(i), F.col("n").alias(f"n{i}"), *[F.col(c).alias(f"{i}{c}") for c in SKETCH])
    need = F.ceil(F.lit(THRESHOLD) * F.greatest("na", "nb") - 1e-9)
    # Bits that differ are words of one text only: at most na + nb less twice those shared.
    differ = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in SKETCH), F.lit(0))
    met = one(keys[0], "a").join(one(keys[1], "b"), ["k1", "k2"])
    pairs = met.where((F.least("na", "nb") >= need) & (differ <= F.col("na") + F.col("nb") - 2 * need)).select("a", "b", "na", "nb").distinct()
    # The whole overlap of the pair, from short forms of the chunks (23 bits of the
    # digest and the size): a chance agreement only lets a pair through to the check.
    brief = F.transform("c", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    part = lambda cond, i: cls.where(cond).where("c is not null").select(F.col("id").alias(i), brief.alias(f"c{i}"))
    shared = F.aggregate(F.array_intersect("ca", "cb"), F.lit(0), lambda x, c: x + c.bitwiseAND(F.lit(255)))
    return pairs.join(part("train", "a"), "a").join(part("not train", "b"), "b").where(shared >= F.lit(share) * F.greatest("na", "nb") - 1e-9).select("a", "b")


def word_places(cls: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sightings of words on the train and the evaluation side, by place."""
    place = F.explode(F.transform("v", lambda x: x.bitwiseAND(F.lit(PLACES - 1)))).alias("place")
    got = cls.select("train", place).groupBy("place").agg(F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e")).toPandas()
    out = np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int64)
    for side_counts, c in zip(out, "te"):
        side_counts[got["place"].to_numpy(np.int64)] = got[c].to_numpy()
    return out


@lru_cache(maxsize=64)
def _pairs(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def word_keys(n: int, v: np.ndarray, freq: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Keys of a short text with the word digests ``v``: pairs of its rarest words; a
    pair that is in ``hot`` (sorted) is replaced by its triples.

    Any order of the words that is the same for all texts keeps the filter exact: the
    first two words that two near-same texts share are among the first spare + 2 of
    either, the third is among the first spare + 3. Words of a place seen on one side
    only cannot be shared. A text of one word has that word as its key; one of two has
    no third word, as have all that it may meet."""
    f = freq[v & (PLACES - 1)]
    there = f > 0
    spare = int(n * (1 - THRESHOLD) + 1e-9) - (len(f) - int(there.sum()))  # words that a near-same text may lack
    if spare < 0:
        return v[:0]
    v, f = v[there], f[there]
    first = v[np.lexsort((v, f))][: spare + 3]
    if n == 1:
        first = np.repeat(first, 2)
    x, y = _pairs(min(len(first), spare + 2))
    out = (first[x] << 32) ^ (first[y] & 0xFFFFFFFF)
    if n < 3 or not len(hot):
        return out
    at = np.minimum(np.searchsorted(hot, out), len(hot) - 1)
    is_hot = hot[at] == out
    if not is_hot.any():
        return out
    # Digests that agree by chance only let more pairs be compared.
    return np.concatenate([out[~is_hot], *(out[i : i + 1] * MIX + first[y[i] + 1 :] for i in np.flatnonzero(is_hot))])


def word_offers(cls: DataFrame, hot_pairs: int = HOT_PAIRS, sample: int = SAMPLE, least: int = SEEN) -> tuple[DataFrame, DataFrame]:
    """(id, n, k, s) of the train and of the evaluation side: the keys of short texts
    (:func:`word_keys`) and a sketch of their words in one number.

    Which pairs are hot is counted on a part of the texts, an eighth of a table with
    more than eight times ``sample``: a pair that it overlooks costs time, not results.
    ``least`` sightings in the part bound their number."""
    t, e = word_places(cls)
    sc = cls.sparkSession.sparkContext
    table_ = sc.broadcast(np.where((t > 0) & (e > 0), t + e, 0))
    short = cls.where("v is not null")

    def keys(texts: DataFrame, hot: Broadcast) -> DataFrame:
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            freq, found = table_.value, hot.value
            for pdf in batches:
                for at in range(0, len(pdf), 1000):  # a batch of texts has many keys
                    part = pdf.iloc[at : at + 1000]
                    vs = [np.asarray(v, np.int64) for v in part["v"]]
                    ks = [word_keys(n, v, freq, found) for n, v in zip(part["n"], vs)]
                    s = [np.bitwise_or.reduce(np.int64(1) << (v >> 20 & 63)) for v in vs]
                    many = [len(k) for k in ks]
                    yield pd.DataFrame({c: np.repeat(part[c].to_numpy(), many) for c in ("id", "train", "n")} | {"k": np.concatenate(ks), "s": np.repeat(s, many)})

        return texts.select("id", "train", "n", "v").mapInPandas(go, "id bigint, train boolean, n int, k bigint, s bigint")

    every = min(8, max(1, short.count() // sample))
    some = keys(short.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), sc.broadcast(np.zeros(0, np.int64)))
    seen = some.groupBy("k").agg(F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e"))
    seen = seen.where((F.col("t") * F.col("e") * F.lit(every * every) > hot_pairs) & (F.col("t") + F.col("e") >= least))
    hot = sc.broadcast(np.sort(seen.select("k").toPandas()["k"].to_numpy(np.int64)))
    return keys(short.where("train"), hot), keys(short.where("not train"), hot)


def word_candidates(keys: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Distinct (a, b, need) that meet under a key and by their sketches may share the
    ``need`` words that are 80 % of the longer one."""
    one = lambda side_, i: side_.select("k", F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("s").alias(f"s{i}"))
    need = F.ceil(F.lit(THRESHOLD) * F.greatest("na", "nb") - 1e-9)
    # Bits that differ are words of one text only, as in candidate_pairs.
    differ = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    met = one(keys[0], "a").join(one(keys[1], "b"), "k")
    return met.where((F.least("na", "nb") >= need) & (differ <= F.col("na") + F.col("nb") - 2 * need)).select("a", "b", need.alias("need")).distinct()


def word_pairs(keys: tuple[DataFrame, DataFrame], cls: DataFrame) -> DataFrame:
    """Distinct (a, b) that meet under a key and hold 80 % of the longer one's words
    in the other."""
    w = lambda cond, i: cls.where(cond).where("v is not null").select(F.col("id").alias(i), F.col("v").alias(f"v{i}"))
    return word_candidates(keys).join(w("train", "a"), "a").join(w("not train", "b"), "b").where(F.size(F.array_intersect("va", "vb")) >= F.col("need")).select("a", "b")


def overlaps(records: DataFrame, key: str, share: float = SHARE, hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(class pairs: a, b, overlap fraction; membership: train, id, key)."""
    prepared = cut(prepare(spread(records), key))
    # A class is represented by its smallest key. The other members are looked up
    # by key, so that the chunks of a record are not moved to find its class.
    least = cut(prepared.groupBy("h").agg(F.min("key").alias("id"), F.count("*").alias("size")).where("size > 1"))
    total = least.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    copies = cut(join_hot(prepared.select("train", "h", "key"), least, "h", "size", total).select("train", "id", "key").where("id != key"))
    cls = prepared.join(copies.select("key"), "key", "left_anti").select("train", F.col("key").alias("id"), "n", "c", "v", *SKETCH)
    cls = cut(cls)
    discard(prepared)
    member = cls.select("train", "id", F.col("id").alias("key")).unionByName(copies)
    # Written one after the other: the shuffle files of the first are gone by then.
    by_chunk = cut(candidate_pairs(offers(cls, share, hot_pairs), cls, share))
    by_word = cut(word_pairs(word_offers(cls), cls))
    pairs = cut(by_chunk.unionByName(by_word).distinct())
    text = records.select(F.col(key).cast("bigint").alias("id"), "text", side(F.col("split")).alias("train"))
    ta = text.where("train").select(F.col("id").alias("a"), F.col("text").alias("xa"))
    tb = text.where("not train").select(F.col("id").alias("b"), F.col("text").alias("xb"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, xa, xb in zip(pdf["a"], pdf["b"], pdf["xa"], pdf["xb"]):
                x, y = words(xa), words(xb)
                if not near_same(x, y):
                    continue
                dy = set(chunks(y)[0])
                shared = sum(w for d, w in zip(*chunks(x)) if d in dy)  # summed chunk lengths
                out.append((a, b, shared / max(len(x), len(y))))
            yield pd.DataFrame(out, columns=["a", "b", "overlap"])

    checked = pairs.join(ta, "a").join(tb, "b").select("a", "b", "xa", "xb").mapInPandas(verify, "a bigint, b bigint, overlap double")
    return checked, member


def expanded(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs of records, from pairs of classes and their members.

    A class of many copies is expanded in blocks, each by a task of its own."""
    sizes = member.groupBy("train", "id").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    out = pairs
    for cond, i in (("train", "a"), ("not train", "b")):
        n = sizes.where(cond).select(F.col("id").alias(i), F.col("blocks").alias(f"blocks_{i}"))
        out = out.join(n, i).withColumn(f"at_{i}", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{i}") - 1)))
        at = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias(f"at_{i}")
        # The classes with more than one block hold more than BLOCK rows each.
        placed = member.where(cond).join(F.broadcast(sizes.where(cond).where("blocks > 1").select("id", "blocks")), "id", "left")
        m = placed.select(F.col("id").alias(i), F.when(F.col("blocks").isNotNull(), at).otherwise(0).alias(f"at_{i}"), F.col("key").alias(f"k{i}"))
        out = out.join(m, [i, f"at_{i}"]).drop(f"at_{i}", f"blocks_{i}")
    return out.select(F.least("ka", "kb").alias("core_row_id_a"), F.greatest("ka", "kb").alias("core_row_id_b"), "overlap")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "core_records").select("core_row_id", "split", "source_family", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one train and one val or test record that are near-same."""
    pairs, member = overlaps(_records(spark, sf_dir), "core_row_id")
    return expanded(pairs, member).select("core_row_id_a", "core_row_id_b")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected evaluation records per split and source family."""
    records = _records(spark, sf_dir)
    pairs, member = overlaps(records, "core_row_id")
    hit = pairs.select(F.col("b").alias("id")).distinct().join(member.where("not train"), "id").select(F.col("key").alias("core_row_id"))
    r = records.select("core_row_id", F.lower(F.trim("split")).alias("split"), "source_family")
    total = r.where("split in ('val', 'test')").groupBy("split", "source_family").agg(F.count("*").alias("n_records"))
    bad = r.join(hit, "core_row_id").groupBy("split", "source_family").agg(F.count("*").alias("n_overlapping"))
    same = (total["split"] == bad["split"]) & total["source_family"].eqNullSafe(bad["source_family"])
    return total.join(bad, same, "left").select(total["split"], total["source_family"], "n_records", F.coalesce("n_overlapping", F.lit(0)).alias("n_overlapping"))
