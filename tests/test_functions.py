"""Text functions against plain-Python forms of their definitions."""

import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import features as X
from corpusloom.functions import text as T

CASES = ["", None, "   ", "word", "a a a", "One. Two!  Three?", "Visit https://x.example/a?b=1 or www.y.example now", "Mail me: a.b@c.example", "naïve café — ok", "ﬁne ①", "x" * 5000, "\x00bad\x07 bytes\r\n\n\n\n\nend"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "id int, text string")


def collect(df, c):
    return {r[0]: r[1] for r in df.select("id", c).collect()}


def test_normalize(rows):
    got = collect(rows, T.normalize_text(F.col("text")))
    for i, t in enumerate(CASES):
        if t is None:
            assert got[i] is None
        else:
            u = re.sub(r"[�\x00-\x1f\x7f]", " ", unicodedata.normalize("NFKC", t))
            assert got[i] == " ".join(u.split())


def test_counts(rows):
    got = collect(rows, T.token_count(F.col("text")))
    words = collect(rows, T.word_count(F.col("text")))
    for i, t in enumerate(CASES):
        assert words[i] == len((t or "").split())
        if t is None or t.isascii():
            assert got[i] == len(re.findall(r"\w+|[^\w\s]", t or ""))


def test_bins(spark):
    cases = [("sms", 19, "short"), ("sms", 20, "medium"), ("sms", 59, "medium"), ("sms", 60, "long"), ("email", 99, "short"), ("email", 100, "medium"), ("email", 400, "long"), ("qa", 74, "short"), ("qa", 75, "medium"), ("qa", 250, "long"), ("fax", 5, None)]
    df = spark.createDataFrame(cases, "channel string, n int, want string")
    assert all(r[0] == r[1] for r in df.select("want", T.length_bin(F.col("n"), F.col("channel"))).collect())
    with pytest.raises(Exception, match="unknown channel"):
        df.select(T.length_bin(F.col("n"), F.col("channel"), strict=True)).collect()


def test_bucket_share_bounds(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    assert df.where(T.bucket_share(F.col("k"), 0)).count() == 0
    assert df.where(T.bucket_share(F.col("k"), 1)).count() == 2000
    assert 300 < df.where(T.bucket_share(F.col("k"), 0.2)).count() < 500


def reference_mtld(words, limit=0.72):
    def one(ws):
        f, start = 0.0, 0
        for i in range(len(ws)):
            seg = ws[start : i + 1]
            if len(set(seg)) / len(seg) <= limit:
                f, start = f + 1, i + 1
        if start < len(ws):
            seg = ws[start:]
            f += (1 - len(set(seg)) / len(seg)) / (1 - limit)
        return len(ws) / f if f else 0.0

    return 0.0 if len(words) < 10 else (one(words) + one(words[::-1])) / 2


def test_mtld():
    for ws in ([], list("abc"), list("abcdefghijkl"), list("abab" * 6), list("the cat sat on the mat the cat".split() * 3)):
        assert X.mtld_of(ws) == pytest.approx(reference_mtld(ws))


def test_hc60_against_python(spark, rows):
    got = {r["id"]: r for r in X.extract_hc60(rows, ["id"]).collect()}
    assert len(got) == len(CASES)
    assert len([c for c in got[0].asDict() if c.startswith("hc60_")]) == 60
    for i, t in enumerate(CASES):
        t = t or ""
        ws = [w.lower() for w in re.findall(r"(?u)\b[a-zA-Z][a-zA-Z']*\b", t)]
        f = Counter(ws)
        r = got[i]
        assert r["hc60_word_count"] == len(ws)
        assert r["hc60_ttr"] == pytest.approx(len(f) / len(ws) if ws else 0)
        assert r["hc60_hapax_ratio"] == pytest.approx(sum(v == 1 for v in f.values()) / len(ws) if ws else 0)
        assert r["hc60_yule_k"] == pytest.approx(1e4 * (sum(v * v for v in f.values()) - len(ws)) / len(ws) ** 2 if len(ws) > 1 else 0)
        c = Counter(t)
        assert r["hc60_char_entropy"] == pytest.approx(-sum(v / len(t) * math.log2(v / len(t)) for v in c.values()) if t else 0, abs=1e-9)
        assert all(v is not None and not math.isnan(v) for k, v in r.asDict().items() if k.startswith("hc60_"))


def test_words_follow_the_definition(spark, sf):
    """The word lists of all texts equal those of the pattern in plain Python."""
    import re

    from corpusloom.functions.text import words_lower

    word = re.compile(r"(?u)\b[a-zA-Z][a-zA-Z']*\b")
    odd = ["10am x7f3 don't dogs' rock'9 it'sé a''b _x x_ naïve can't-do O'Neil's", "", None]
    texts = [r[0] for r in spark.read.parquet(f"{sf}/core_records.parquet").select("text").collect()] + odd
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["w"] for r in df.select("i", words_lower(df["t"]).alias("w")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != [w.lower() for w in word.findall(t or "")]] == []
