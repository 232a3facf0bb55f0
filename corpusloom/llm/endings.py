"""How texts end: shared by the detectors of truncated texts (problems 5, 10).

Three looks at each distinct text, all over whole tables:

* **Prefix self-join.** The values are the texts and their sentences, with names,
  numbers and codes read as classes, stray marks of the break removed and the last
  word as it stands. They are sorted; an unfinished last sentence (or text) that is
  a strict prefix of a longer value elsewhere, and never a whole one, was cut off.
* **Length spikes** of a source, in characters or bytes (texts of one
  template agree in words, so counts of words would accuse them).
* **Phrase counts**, where no longer copy exists: the last two or three words are
  looked up among the same words of all texts; where they hardly ever stop, the text
  was cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.overlap import join_hot
from corpusloom.session import cut

TOKEN = regex.compile(r"\n+|\[URL\]|(?:[$€£]|US\$)?\d[\d.,:]*\d%?|(?:[$€£]|US\$)?\d%?|[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*|[^\s\p{L}\p{M}\p{N}]")
#: The same for ASCII texts, by the faster engine.
_ASCII = re.compile(r"\n+|\[URL\]|(?:\$|US\$)?[0-9][0-9.,:]*[0-9]%?|(?:\$|US\$)?[0-9]%?|[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*|[^ \t-\rA-Za-z0-9]")
TERMINAL = frozenset(".!?。！？")
CLOSERS = "\"'”’»)]*_"
#: Key levels from the least to the most specific: the last word; two words and
#: three words, with the last as a shape; three words.
LEVELS = 4
#: Titles and the like whose full stop does not end a sentence (fixed values).
ABBREVIATED = frozenset("mr mrs ms dr prof st no nr vs etc".split()) - {"etc"}


def tokens(text: str) -> list[str]:
    return (_ASCII if text.isascii() else TOKEN).findall(text)


def _mask(tok: str, starts: bool) -> str:
    c = tok[0]
    if c == "\n":
        return "\n"
    if any(x.isdigit() for x in tok):
        return "#a" if regex.search(r"\p{L}", tok) else "#%" if tok[-1] == "%" else "#$" if not tok[0].isdigit() else "#"
    if c.isalpha():
        return "Xx" if c.isupper() and not starts and len(tok) > 1 else tok.lower()
    return tok


def mask(tok: str, starts: bool) -> str:
    """Names, numbers and codes as classes; other words in lower case. A capital
    tells a name only where no sentence starts."""
    return _known(tok, starts)[0]


def shape(tok: str, m: str) -> str:
    if m[0] != "#" and tok[:1].isalpha():
        return "w" if tok[:1].islower() else "W"
    return m


#: (mask, shape) of short tokens inside and at the start of a sentence.
_seen: tuple[dict, dict] = ({}, {})


def _known(tok: str, starts: bool) -> tuple[str, str]:
    got = _seen[starts].get(tok)
    if got is None:
        m = _mask(tok, starts)
        got = (m, shape(tok, m))
        if len(tok) < 40:
            if len(_seen[starts]) > 1 << 17:
                _seen[starts].clear()
            _seen[starts][tok] = got
    return got


def masked(toks: list[str]) -> list[str]:
    out, starts = [], True
    for t in toks:
        out.append((_seen[starts].get(t) or _known(t, starts))[0])
        starts = t in TERMINAL
    return out


def phrases_of(group: str, a: str, b: str, c: str, s: str) -> list[tuple]:
    """Phrases that end in c (of shape s) after a and b, one per level."""
    return [(group, 0, c), (group, 1, b, s), (group, 2, a, b, s), (group, 3, a, b, c)]


def keys_at(group: str, m: list[str], toks: list[str], i: int) -> list[int]:
    """The same at token i, hashed."""
    return [_h(*p) for p in phrases_of(group, m[i - 2] if i > 1 else "^", m[i - 1] if i else "^", m[i], shape(toks[i], m[i]))]


def _h(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def body(text: str) -> str:
    return text.rstrip()


def _body(c: str) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+$", "")


#: Sightings, sentence ends and text ends of a phrase in one unbounded number.
_BREAK, _END = 1 << 64, 1 << 128


def observe(text: str, group: str, seen: dict[tuple, int]) -> None:
    """Adds every three words of the text, with how they go on. The less specific
    phrases are sums over these."""
    toks = tokens(body(text))
    get = seen.get
    a = b = "^"
    starts = True
    for t, nxt in zip(toks, [*toks[1:], None]):
        c, form = _seen[starts].get(t) or _known(t, starts)
        starts = t in TERMINAL
        key = (group, a, b, c, form)
        if nxt is None:
            seen[key] = get(key, 0) + 1 + _END
        elif nxt in TERMINAL or nxt[0] in "\n&":
            seen[key] = get(key, 0) + 1 + _BREAK
        else:
            seen[key] = get(key, 0) + 1
        a, b = b, c


def tail(text: str, least: int = 5) -> list[str]:
    """Tokens of the text from a blank on, at least ``least`` if there are so many."""
    n, size = len(text), 200
    while n > size:
        at = max(text.rfind(" ", 0, n - size), text.rfind("\n", 0, n - size))
        if at < 0:
            break
        toks = tokens(text[at + 1 :])
        if len(toks) >= least:
            return toks
        size *= 4
    return tokens(text)


def final(text: str, group: str) -> tuple[list[int], list[int], str, str]:
    """(keys at the last token, keys before a final full stop, last word, last token)."""
    toks = tail(body(text))
    if not toks:
        return [], [], "", ""
    m = masked(toks)
    before = keys_at(group, m, toks, len(toks) - 2)[-1:] if toks[-1] in TERMINAL and len(toks) > 1 else []
    last = toks[-1] if toks[-1][0].isalpha() else ""
    return keys_at(group, m, toks, len(toks) - 1), before, last, toks[-1]


# ---- distributed counts -----------------------------------------------------------

def phrase_counts(texts: DataFrame) -> DataFrame:
    """(key, n, breaks, ends) over all texts; summed before the shuffle."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = _BREAK - 1
        for pdf in batches:
            seen: dict[tuple, int] = {}
            for t, g in zip(pdf["text"], pdf["grp"]):
                observe(t, g, seen)
            sums: dict[tuple, int] = {}
            for key, v in seen.items():
                for p in phrases_of(*key):
                    sums[p] = sums.get(p, 0) + v
            yield pd.DataFrame([(_h(*p), v & low, (v >> 64) & low, v >> 128) for p, v in sums.items()], columns=["key", "n", "breaks", "ends"])

    got = texts.where("text is not null").select("text", "grp").mapInPandas(go, "key bigint, n bigint, breaks bigint, ends bigint")
    return got.groupBy("key").agg(F.sum("n").alias("n"), F.sum("breaks").alias("breaks"), F.sum("ends").alias("ends"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): whole words, which something or a final full stop follows."""
    word = F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}]+)(?=[^\p{L}\p{M}\s]*(?:\s+\S|[.!?。！？][^\p{L}\p{M}\s]*\s*$))"), F.lit(1))).alias("word")
    return texts.select(word).groupBy("word").agg(F.count("*").alias("n"))


#: Letters up to which every beginning of a word is counted; longer ones are met by
#: their first LONG letters and compared.
LONG = 24


def prefix_counts(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, longer, best) of the ``asked`` words: how often words that go on after
    them are seen in all, and the most frequent one. From the vocabulary, not the texts."""
    cuts = F.explode(F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(LONG)))).alias("k")
    pre = words.where("length(word) > 1").select("word", "n", cuts).select(F.expr("substring(word, 1, k)").alias("word"), "n")
    head = F.substring("word", 1, LONG).alias("head")
    far = words.where(F.length("word") > LONG).select(head, F.col("word").alias("w"), "n").join(asked.where(F.length("word") > LONG).select(head, "word"), "head")
    far = far.where(F.col("w").startswith(F.col("word")) & (F.col("w") != F.col("word"))).select("word", "n")
    return pre.unionByName(far).groupBy("word").agg(F.sum("n").alias("longer"), F.max("n").alias("best")).join(asked.select("word"), "word", "left_semi")


# ---- sorted neighbours ---------------------------------------------------------------

def shortened(texts: DataFrame) -> DataFrame:
    """(text) of the distinct texts that are a strict prefix of another one.

    Distinct texts are sorted across partitions; whatever starts with a text
    follows it directly, so each needs only its successor. The successor of a
    partition's last text is the first text of the next partition that has any;
    these two rows a partition are all that meets in one place."""
    base = texts.where("text is not null").select(F.rtrim("text").alias("text")).where("text != ''").distinct()

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        first, last = True, None
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                if first:
                    out.append((pid, "first", t))
                    first = False
                elif t.startswith(last):
                    out.append((pid, "hit", last))
                last = t
            yield pd.DataFrame(out, columns=["pid", "kind", "text"])
        if last is not None:
            yield pd.DataFrame([(pid, "last", last)], columns=["pid", "kind", "text"])

    n = base.sparkSession.sparkContext.defaultParallelism
    out = cut(base.repartitionByRange(n, "text").sortWithinPartitions("text").mapInPandas(go, "pid int, kind string, text string"))
    edge = Window.orderBy("pid", F.when(F.col("kind") == "first", 0).otherwise(1))
    seam = out.where("kind != 'hit'").withColumn("next", F.lead("text").over(edge)).where("kind = 'last' and startswith(next, text) and next != text")
    return out.where("kind = 'hit'").select("text").unionByName(seam.select("text"))


def values(text: str) -> tuple[list[str], str | None, str | None]:
    """(whole sentences, unfinished last sentence, unfinished text), masked. What a
    stray mark of the break follows is unfinished; None if nothing is."""
    t = body(text)
    stray = STRAY.search(t)
    toks = tokens(body(t[: stray.start()]) if stray else t)
    m = masked(toks)
    out, start = [], 0
    for i, tok in enumerate(toks):
        if tok in TERMINAL or tok[0] == "\n":
            if i > start:
                out.append(" ".join(m[start:i]))
            start = i + 1
    if start == len(toks) or m[-1][0] == "#" or m[-1] == "[URL]":  # numbers, codes and links are whole
        return out, None, None
    last = "X" if len(toks[-1]) == 1 and toks[-1].isupper() and len(toks) - start > 1 else m[-1]
    return out, " ".join([*m[start:-1], last]), "^ " + " ".join([*m[:-1], last])


def longer_copies(bodies: DataFrame) -> DataFrame:
    """(h): digests of unfinished sentences and texts that are a strict prefix of a
    longer value and are no whole sentence anywhere."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, bool] = {}
            for t in pdf["text"]:
                whole, open_, text = values(t)
                for x in whole:
                    seen[x] = True
                for x in (open_, text):
                    if x:
                        seen.setdefault(x, False)
            yield pd.DataFrame(list(seen.items()), columns=["text", "whole"])

    all_ = cut(bodies.select("text").mapInPandas(go, "text string, whole boolean").groupBy("text").agg(F.max("whole").alias("whole")))
    hits = shortened(all_).join(all_.where("not whole").select("text"), "text", "left_semi")
    return hits.select(F.xxhash64("text").alias("h"))


def length_spikes(texts: DataFrame, by: str) -> DataFrame:
    """(by, unit, len): lengths in characters or bytes far more frequent than the
    lengths around them; counted over distinct texts. One row a source and length."""
    once = texts.where("text is not null").select(by, *_lengths(), F.xxhash64("text").alias("_h")).distinct()
    unit = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(f"_{u}").alias("len")) for u in "cb"))).alias("x")
    hist = once.select(by, unit).groupBy(by, "x.unit", "x.len").agg(F.count("*").alias("n"))
    near = Window.partitionBy(by, "unit").orderBy("len").rangeBetween(-5, 5)
    around = (F.sum("n").over(near) - F.col("n")) / F.lit(10.0)
    return hist.withColumn("around", around).where((F.col("n") >= 8) & (F.col("n") > 5 * (F.col("around") + 1))).select(by, "unit", "len")


def _lengths() -> list[Column]:
    return [F.length("text").alias("_c"), F.octet_length("text").alias("_b")]


def with_evidence(texts: DataFrame, key: str, by: str, prefixes: bool = True) -> DataFrame:
    """Distinct ``texts`` (key, text, grp, by) with what the corpus says about each
    ending: counts of its last phrases and word, length spike, longer copy."""
    kind = texts.schema[key].dataType.simpleString()
    some = texts.where("text is not null")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, g in zip(pdf[key], pdf["text"], pdf["grp"]):
                keys, before, last, _ = final(t, g)
                _, open_, whole = values(t) if prefixes else (None, None, None)
                out.append((i, keys + before, last, open_, whole))
            yield pd.DataFrame(out, columns=[key, "keys", "word", "open", "whole"])

    facts = some.select(key, "text", "grp").mapInPandas(look, f"{key} {kind}, keys array<bigint>, word string, open string, whole string")
    facts = cut(facts.withColumns({"open": F.xxhash64("open"), "whole": F.xxhash64("whole")}))
    # One sighting a class: texts that differ in source or outer blanks only are copies too.
    bodies = cut(some.select(_body("text").alias("text"), "grp").distinct())
    plain = bodies.select("text").distinct()

    asked = facts.select(key, F.posexplode("keys").alias("place", "key"))
    want = asked.groupBy("key").agg(F.count("*").alias("freq"))
    # A phrase seen once is the text's own.
    known = cut(want.join(phrase_counts(bodies).where("n > 1"), "key"))
    found = join_hot(asked, known, "key", "freq", _sum(known, "freq"))
    phrases = found.groupBy(key).agg(F.collect_list(F.struct("place", "n", "breaks", "ends")).alias("phrases"))

    lasts = facts.where("word != ''").select(key, "word")
    ended = cut(lasts.groupBy("word").agg(F.count("*").alias("freq")))
    vocab = cut(word_counts(plain))
    about = cut(ended.join(vocab.withColumnRenamed("n", "n_word"), "word", "left").join(prefix_counts(vocab, ended), "word", "left"))
    word = join_hot(lasts, about, "word", "freq", _sum(about, "freq")).select(key, "n_word", "longer", "best")

    spikes = F.broadcast(length_spikes(some, by))  # at most 1/8 as many rows as a source has lengths
    sized = some.select(key, by, *_lengths())
    marked = None
    for u in "cb":
        hit = sized.select(key, by, F.col(f"_{u}").alias("len")).join(spikes.where(F.col("unit") == u).drop("unit"), [by, "len"], "left_semi").select(key)
        marked = hit if marked is None else marked.unionByName(hit)
    out = texts.join(phrases, key, "left").join(word, key, "left").join(marked.distinct().withColumn("spike", F.lit(True)), key, "left")
    if not prefixes:
        return out.withColumn("copy", F.lit(False))
    ends = facts.select(key, F.explode(F.array("open", "whole")).alias("h"))
    freq = ends.groupBy("h").agg(F.count("*").alias("freq"))
    longer = cut(freq.join(longer_copies(bodies), "h", "left_semi"))
    copied = join_hot(ends, longer, "h", "freq", _sum(longer, "freq")).select(key).distinct().withColumn("copy", F.lit(True))
    return out.join(copied, key, "left")


def _sum(df: DataFrame, c: str) -> int:
    return df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]


def judge(pdf: pd.DataFrame) -> list[bool]:
    """Whether each row of :func:`with_evidence` is unfinished."""
    out = []
    num = lambda x: 0 if x is None or x != x else int(x)
    for t, g, phrases, n, longer, best, spike, copy in zip(*(pdf[c] for c in ("text", "grp", "phrases", "n_word", "longer", "best", "spike", "copy"))):
        if t is None:
            out.append(False)
            continue
        at: list = [None] * (LEVELS + 1)  # the last place is the phrase before a final full stop
        for p in phrases if phrases is not None else ():
            at[p["place"]] = (p["n"], p["breaks"], p["ends"])
        out.append(unfinished(t, g, at[:LEVELS], at[LEVELS:], num(n), num(longer), num(best), spike is True, copy is True))
    return out


def with_verdict(texts: DataFrame, by: str, prefixes: bool = True) -> DataFrame:
    """``texts`` (text, grp, by and others) with ``unfinished``; null texts are not.

    Each distinct text of a source and group is judged once. ``prefixes`` switches
    the prefix self-join off, to see what it decides."""
    ident = F.xxhash64("text", "grp", by)
    once = cut(texts.where("text is not null").select("text", "grp", by).distinct().withColumn("_id", ident))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[judge(pdf), ["_id"]]

    cases = with_evidence(once, "_id", by, prefixes).mapInPandas(go, "_id bigint").withColumn("unfinished", F.lit(True))
    rows = texts.withColumn("_id", F.when(F.col("text").isNotNull(), ident)).join(cases, "_id", "left")
    return rows.withColumn("unfinished", F.coalesce("unfinished", F.lit(False))).drop("_id")


# ---- decision ------------------------------------------------------------------------

#: Weight of the less specific phrase in the share of the more specific one.
BACKOFF = 10.0
#: Share of stops below which a phrase is one that goes on.
STOPS = {"e": 0.05, "s": 0.04}  # mail and other texts; short messages
#: The same for the last word alone, with one stop more than was seen.
NEVER_STOPS = 0.004
#: The same where a longer copy of the last sentence was found.
STOPS_BESIDE_COPY = 0.1
#: Sightings needed to hold a final full stop for a mere mark (of a number, say).
ENOUGH = 24


def stop_share(counts: list[tuple[int, int, int] | None]) -> float:
    """Share of the sightings of the last phrase elsewhere that stop there, from
    the least to the most specific phrase; the text itself is left out. The word
    alone only tells that a text goes on, not that it stops."""
    share = 0.1
    for level, c in enumerate(counts):
        if c is not None and c[0] > 1:
            share = (c[1] + max(0, c[2] - 1) + BACKOFF * share) / (c[0] - 1 + BACKOFF)
        if level == 0:
            share = min(share, 0.1)
    return share


def before_stop_share(counts: list[tuple[int, int, int] | None]) -> tuple[float, int]:
    """As above for the words before a final full stop; only the exact phrases."""
    for c in reversed(counts):
        if c is not None and c[0] - 1 >= ENOUGH:
            return (max(0, c[1] - 1) + c[2]) / (c[0] - 1), c[0] - 1
    return 0.5, 0


STRAY = regex.compile(r"(?:=|…|\.\.\.|�+|\[\.\.\.\]|\[…\]|<[a-z/]*|&[a-z#0-9]*|\\|\[truncated\]|\[cut\]|--|[-–—/])\s*$")


def unfinished(text: str, group: str, counts: list, before: list, n_word: int, longer: int, best: int, spike: bool, copy: bool = False) -> bool:
    """Whether the text stops inside a word or sentence."""
    keys, _, last, tok = final(text, group)
    if not keys:
        return False
    t = body(text)
    if t.endswith("�"):
        return True
    stray = STRAY.search(t)
    if stray:
        head = t[: stray.start()].rstrip()
        if not head:
            return False
        return head[-1:] not in ".!?。！？:" or stray.group().strip() in ("=",)
    if tok in TERMINAL:
        word = tokens(t)[-2].lower() if len(tokens(t)) > 1 else ""
        if word in ABBREVIATED:
            return True
        share, n = before_stop_share(before)
        return bool(n) and share < 0.004
    if t[-1] in ",;:(" or t[-1] in "$€£&#":
        share = stop_share(counts)
        return share < STOPS[group] or t[-1] in ",;("
    if tok[0].isalnum() or tok == "[URL]":
        share = stop_share(counts)
        if spike or (copy and share < STOPS_BESIDE_COPY):
            return True
        if last[:1].islower() and counts[0] and (counts[0][1] + counts[0][2] + 1) / (counts[0][0] + 1) < NEVER_STOPS:
            return True
        # A word that other texts end on is whole, too; names share one class and say nothing.
        whole = n_word + (max(0, counts[0][2] - 1) if last[:1].islower() and counts[0] else 0)
        if last and longer > 20 * (whole + 1) and best > 10 * (whole + 1):
            return True
        if text[len(t) :] == " " and share < 0.3:
            return True
        return share < STOPS[group]
    return spike and tok[0] in ",-'’"
