"""Training-data operators: brute force, edge cases, held-out accuracy."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import endings, leaks, lookalikes, mailparts, mixture, mojibake, overlap, pairs, pii, quota_sample, truncated
from corpusloom.llm import queries as Q
from corpusloom.llm import textform as tf

LONG = "the quick brown fox jumps over the lazy dog and runs into the green forest near the river bank " * 3


@pytest.mark.parametrize(
    "text,want",
    [
        ("plain text", "plain text"), ("Ｆｕｌｌ", "Full"), ("𝗻𝗲𝗮𝗿", "near"), ("été", "été"), ("a​b", "ab"), ("a b", "a b"), ("Cаll", "Call"),
        ("Привет мир", "Привет мир"), ("“ok” … ½ ™", "“ok” … ½ ™"), ("👨‍👩‍👧 ❤️ 1️⃣", "👨‍👩‍👧 ❤️ 1️⃣"), (None, None), ("", ""), ("x́", "x́"),
    ],
)
def test_canonical(text, want):
    assert tf.canonical(text) == want
    assert tf.canonical(tf.canonical(text)) == want


def test_trie_prefers_frequent_zero_cost_words():
    t = lookalikes.Trie()
    for w, n in (("pay", 3), ("pal", 9)):
        t.add(w, n)
    assert t.match("pаy")[0][2] == "pay"
    assert t.match("p​аl")[0][2] == "pal"
    assert t.match("zzz") == []


def test_unify(spark):
    rows = [("a", 1, "Cаll now"), ("a", 2, "Call now"), ("a", 3, None), ("a", 4, ""), ("b", 1, "x" * 20000 + "​"), ("a", 2, "Call now")]
    df = spark.createDataFrame(rows, "src string, row_key long, text string").withColumn("run", F.lit(1)).withColumn("changed", F.lit(7))
    got = lookalikes.unify(df, ["src", "row_key"], "text")
    assert got.count() == 6
    changed = {(r["src"], r["row_key"]): r["text"] for r in got.where("changed").collect()}
    assert changed == {("a", 1): "Call now", ("b", 1): "x" * 20000}
    assert lookalikes.unify(df.where("row_key < 0"), ["src", "row_key"], "text").count() == 0


def test_unify_batch_without_runs(spark):
    """A batch may hold accents, quotes or emoji but no run that could change."""
    rows = [("a", 1, "café"), ("a", 2, "“ok” 👍"), ("a", 3, "plain"), ("a", 4, None)]
    df = spark.createDataFrame(rows, "src string, row_key long, text string").coalesce(1)
    got = lookalikes.unify(df, ["src", "row_key"], "text").collect()
    assert sorted((r["src"], r["row_key"], r["text"]) for r in got) == rows
    assert not any(r["changed"] for r in got)
    odd = spark.createDataFrame([("b", 1, "Cаll")], df.schema).coalesce(1)
    both = {(r["src"], r["row_key"]): r["text"] for r in lookalikes.unify(df.unionByName(odd), ["src", "row_key"], "text").where("changed").collect()}
    assert both == {("b", 1): "Call"}


def garble(text, page, times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode("utf-8"))
    return text


def test_mojibake_round_trip(spark):
    clean = ["I’ll meet Renée at the café, it costs £30.", "He said “no” – twice, 30° outside.", "NÃO is the reply. INFORMAÇÃO. ÂGE.", "Straße €25 naïve"]
    rows, want = [], {}
    for i, (page, times) in enumerate([("cp1252", 1), ("latin-1", 1), ("cp1251", 1), ("mac-roman", 1), ("cp437", 1), ("cp1252", 2)] * 3):
        for j, t in enumerate(clean):
            rows.append(("s", i * 10 + j, garble(t, page, times)))
            want[i * 10 + j] = t
    n = len(rows)
    rows += [("s", 1000 + k, clean[k % 4]) for k in range(200)] + [("s", 2000, None), ("s", 2001, ""), ("s", 2002, "lost caf�"), ("s", 2002, "lost caf�")]
    got = {r["rec_id"]: r for r in mojibake.restore(spark.createDataFrame(rows, "src string, rec_id long, text string")).collect()}
    assert [i for i in want if got[i]["restored"] != want[i]] == []
    assert not any(got[1000 + k]["garbled"] for k in range(200))
    assert got[2002]["lost"] and not got[2000]["garbled"] and not got[2001]["garbled"] and n == len(want)
    assert mojibake.restore(spark.createDataFrame([], "src string, rec_id long, text string")).count() == 0


def test_overlap_brute_force(spark, sf):
    r = spark.read.parquet(f"{sf}/core_records.parquet").select("core_row_id", "split", "text")
    extra = [(900001, " Train", LONG), (900002, "val", LONG.replace("fox", "cat")), (900003, "TEST ", LONG.upper()), (900004, "train", None), (900005, "val", ""), (900006, "train", LONG * 20), (900007, "other", LONG), (900008, "train", LONG)]
    r = r.unionByName(spark.createDataFrame(extra, "core_row_id long, split string, text string"))
    rows = [(x[0], (x[1] or "").strip().lower(), overlap.words(x[2])) for x in r.collect() if x[2]]
    train, rest = [x for x in rows if x[1] == "train" and x[2]], [x for x in rows if x[1] in ("val", "test") and x[2]]

    def plain_lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diag = 0
            for j, y in enumerate(b):
                diag, row[j + 1] = row[j + 1], diag + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    want = set()
    for i, _, a in train:
        for j, _, b in rest:
            m = max(len(a), len(b))
            if min(len(a), len(b)) >= 0.8 * m and len(set(a) & set(b)) > 0.3 * len(set(a)) and plain_lcs(a, b) >= 0.8 * m:
                want.add((min(i, j), max(i, j)))
    for hot in (overlap.HOT_PAIRS, 1):  # every shared chunk hot: pairs of chunks carry the join
        p, m = overlap.overlaps(r, "core_row_id", hot_pairs=hot)
        got = [(x[0], x[1]) for x in overlap.expanded(p, m).select("core_row_id_a", "core_row_id_b").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {(900001, 900002), (900001, 900003), (900002, 900008), (900003, 900008)} <= want


def test_overlap_spread_edits(spark):
    """Edits that leave hardly a chunk whole are found as well."""
    vocabulary = [f"{a}{b}" for a in "ka lo mi nu pe ra so ti vu za".split() for b in "bel dor fin gam hul jik".split()]
    rows, want = [], set()
    for i in range(60):
        a = [vocabulary[(i * 7 + k * k + 3 * k) % len(vocabulary)] for k in range(25 + i % 9)]
        b = [f"x{i}" if k % 5 == 2 else w for k, w in enumerate(a)]
        if not overlap.near_same(a, b):
            b = [f"x{i}" if k % 6 == 2 else w for k, w in enumerate(a)]
        rows += [(2 * i, "train", " ".join(a)), (2 * i + 1, "test", " ".join(b))]
    texts = {i: t.split() for i, _, t in rows}
    want = {(i, j) for i in range(0, 120, 2) for j in range(1, 120, 2) if overlap.near_same(texts[i], texts[j])}
    df = spark.createDataFrame(rows, "core_row_id long, split string, text string")
    for hot in (overlap.HOT_PAIRS, 1):
        pairs, _ = overlap.overlaps(df, "core_row_id", hot_pairs=hot)
        assert {(r["a"], r["b"]) for r in pairs.collect()} == want and len(want) >= 60


def test_lcs():
    assert overlap.lcs("a b c d".split(), "a c d e".split()) == 3
    assert overlap.near_same("a b c d e".split(), "a b x d e".split()) and not overlap.near_same("a b c d".split(), "d c b a".split())


def test_sample(spark, sf):
    rows = spark.read.parquet(f"{sf}/core_records.parquet")
    targets = spark.read.parquet(f"{sf}/sample_targets.parquet")
    a, report = quota_sample.sample(rows, targets, "core_row_id")
    b, _ = quota_sample.sample(rows.repartition(9), targets, "core_row_id")
    chosen = {tuple(x) for x in a.collect()}
    assert chosen == {tuple(x) for x in b.collect()} and len(chosen) == a.count()
    for r in report.collect():
        assert r["n_sampled"] >= min(r["required"], r["n_eligible"]) and r["short"] == (r["n_eligible"] < r["required"])
    none, empty = quota_sample.sample(rows.where("core_row_id < 0"), targets, "core_row_id")
    assert none.count() == 0 and empty.where("short").count() == targets.where("min_rows > 0").count()


def test_sample_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(quota_sample, "RANGE_ROWS", 7)  # many ranges in one cell
    rows = spark.range(500).select(F.col("id").alias("core_row_id"), F.lit("F").alias("scenario_family"), F.lit("c").alias("channel"), F.lit("s").alias("length_bin"))
    targets = spark.createDataFrame([(1, "f", "C", "s", 1000, 5)], "target_id long, scenario_family string, channel string, length_bin string, target_permille int, min_rows int")
    chosen, _ = quota_sample.sample(rows, targets, "core_row_id")
    assert chosen.count() in (100, 101) and chosen.distinct().count() == chosen.count()


PII = [
    ("Write to jo.smith@mail.example today", {"email"}), ("Mail jo AT mail DOT example now", {"email"}), ("jo[at]mail[dot]example", {"email"}), ("Call 206-555-0143 now", {"phone"}), ("Ring two zero six five five five zero one four three now", {"phone"}),
    ("My SSN is 922-25-1547", {"id_number"}), ("passport no. X14847675", {"id_number"}), ("Deliver to 411 Chantry Close, Thornford", {"street_address"}), ("Birkenstraße 21, Berg", {"street_address"}), ("Dear Mr. Garanstow, hello", {"person_name"}),
    ("Text STOP to 26505 to opt out", set()), ("The SSN field ending 4556 is masked.", set()), ("Ticket 721-78-4176-1 is closed.", set()), ("Dial-in conference id 5219122.", set()), ("Invoice 16409265 covers it", set()),
    ("Follow @cobalt on the intranet.", set()), ("Meet in Building 9 Room 158.", set()), ("Paul! your reward waits", set()), ("Between 2001-01-14 and 2002-05-25 nothing moved.", set()),
]


def test_pii_held_out(spark, sf):
    """Learned on the tables, judged on sentences that are not in them."""
    records = pii._records(spark, sf)
    gaz = pii.learn_gazetteer(records)
    model = pii.SpanClassifier.train(pii.count_patterns(records, gaz))
    for text, want in PII:
        got = {k for k, _, _ in pii.finds(pii.plain(text), gaz, model)}
        assert got == want, text
    text = "Call 206-555-0143 or jo@mail.example"
    assert pii.mask(text, pii.finds(text, gaz, model)) == "Call [PHONE] or [EMAIL]"


def test_redact_edges(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, ""), ("s", 3, "Call 206-555-0143 now " * 500)], "src string, rec_id long, text string")
    got = {r["rec_id"]: r for r in pii.redact(df).collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[1]["finds"] == []
    assert pii.redact(df.where("rec_id < 0")).count() == 0


PAIRS = [
    (None, None, "empty"), ("Write it", "  \n", "empty"), ("Write it", "[empty]", "empty"), ("Write it", "N/A", "empty"), ("Give me a short text about a late parcel today", "give me a short text about a late parcel today", "copies_prompt"),
    ("Write a mail", "I'm sorry, but I can't help with messages meant to deceive people.", "refusal"), ("Write a mail", "Unfortunately I must decline to write this.", "refusal"), ("Write a mail", "We must decline the revised template from Ganth.", None),
    ("Write a mail", "Sorry, I won't be able to review it before 12:35.", None), ("Write a mail", "Wir müssen die Rechnung heute noch prüfen und die Übergabe bestätigen.", "wrong_language"), ("Write a mail. The message has to be in German.", "Wir müssen die Rechnung heute noch prüfen.", None),
    ("Write a mail. Write it in French.", "We have to check the invoice and confirm it today for you.", "wrong_language"), ("Write a text", "👍", None),
]


@pytest.mark.parametrize("prompt,text,want", PAIRS)
def test_pair_rules(prompt, text, want):
    assert pairs.rule_defect(prompt, text) == want


def test_shortened_brute_force(spark):
    texts = ["a", "ab", "abc", "b", "b", "bc d", "bc", "zz", None, "", "c" * 3000, "c" * 2999 + "d", "Z", "zza\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    real = {t.rstrip(" ") for t in texts if t}
    want = {a for a in real if any(b != a and b.startswith(a) for b in real)}
    for n in (1, 3, 8):
        assert {r[0] for r in endings.shortened(df.repartition(n)).collect()} == want
    assert endings.shortened(df.where("text = 'no'")).count() == 0


def test_truncation_held_out(spark):
    """Cut sentences against whole ones of the same kind."""
    names = "Ana Ben Cara Dan Eva Finn Gus Hana Ida Jon".split()
    things = "ledger parcel invoice contract schedule report budget memo".split()
    whole = [f"Please send the {b} to {a} before Friday because the {c} needs a new signature. Best regards,\n{d}" for a in names for b in things for c in things[:4] for d in names[:2]]
    cut = [t[: 25 + (i * 7) % (len(t) - 45)] for i, t in enumerate(whole[::16])]
    rows = [(i, t, "s", "email") for i, t in enumerate(whole)] + [(10_000 + i, t, "s", "email") for i, t in enumerate(cut)] + [(20_000, None, None, None), (20_001, "", "s", "email"), (20_002, " ", None, "sms")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, channel string")
    got = {r["doc_id"]: r["truncated"] for r in truncated.truncated(df, "doc_id", "source").collect()}
    assert len(got) == len(rows)
    wrong = [i for i in range(len(whole)) if got[i]]
    found = sum(got[10_000 + i] for i in range(len(cut)))
    assert not wrong and found >= 0.8 * len(cut)
    assert not (got[20_000] or got[20_001] or got[20_002])
    assert truncated.truncated(df.where("doc_id < 0"), "doc_id", "source").count() == 0


def test_copies_are_no_proof_of_an_end(spark):
    """A cut text delivered many times, also to another source or with blanks, is still cut."""
    names = "Ana Ben Cara Dan Eva Finn Gus Hana Ida Jon".split()
    things = "ledger parcel invoice contract schedule report budget memo".split()
    whole = [f"Please send the {b} to {a} before Friday because the {c} needs a new signature. Best regards,\n{d}" for a in names for b in things for c in things[:4] for d in names[:2]]
    part = "We moved the old piano to the barn before Friday because the"
    rows = [(i, t, "s", "email") for i, t in enumerate(whole)] + [(10_000 + i, part + " " * (i % 3), "st"[i % 2], "email") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, channel string")
    got = {r["doc_id"]: r["truncated"] for r in truncated.truncated(df, "doc_id", "source").collect()}
    assert len(got) == len(rows) and not any(got[i] for i in range(len(whole)))
    assert all(got[10_000 + i] for i in range(100))


@pytest.mark.parametrize("word,n,longer,best,want", [("f", 1, 500, 250, True), ("f", 40, 16000, 8000, True), ("f", 40, 800, 400, False), ("internationali", 0, 600, 600, True), ("stop", 3, 300, 200, False)])
def test_cut_words_are_judged_by_shares(word, n, longer, best, want):
    """The same shares give the same verdict in a larger corpus."""
    counts = [(100, 30, 20)] * endings.LEVELS  # other texts end there 19 times
    assert endings.unfinished(f"Please wait {word}", "e", counts, [], n, longer, best, False) is want


def test_length_spikes_count_texts(spark):
    """Copies of one text are no field limit; many texts of one length are."""
    texts = ["x" * 40] * 50 + [f"{i:060d}" for i in range(50)]
    got = endings.length_spikes(spark.createDataFrame([(t, "s") for t in texts], "text string, source string"), "source")
    assert {r["len"] for r in got.collect()} == {60}


MAIL = """Hello Ana,

Please see 1) old > new.

Best,
Ben

Ben Archer
Field Engineer | Some Firm
206-555-0143 | ben@firm.example

This message and any attachments are confidential; please destroy it if it was not meant for you.

On Thu, Jun 28, 2001 at 12:09, Ana Bell wrote:
> Dear Ben,
>> nested
> Regards, Ana"""


def test_mail_grammar():
    text, kinds = mailparts.split_mail(MAIL)
    assert kinds == ["disclaimer", "quoted", "signature"]
    assert text == "Hello Ana,\n\nPlease see 1) old > new.\n\nBest,\nBen"
    assert mailparts.split_mail(None) == (None, []) and mailparts.split_mail("") == ("", [])
    assert mailparts.split_mail("Hi\n\nThanks,\nAna")[1] == []
    assert mailparts.split_mail("Hi\n\nFrom: my point of view, to: yours, nothing changes.")[1] == []
    assert mailparts.split_mail("Keep this confidential between us.")[1] == []
    assert mailparts.split_mail("> all quoted") == ("", ["quoted"])
    assert mailparts.split_mail("Hi\n\nSent from my phone")[1] == ["signature"]
    assert mailparts.split_mail("Hi\n\n-----Original Message-----\nFrom: A B\nSent: x\n\ntext")[1] == ["quoted"]
    assert mailparts.split_mail("> " * 500 + "deep")[1] == ["quoted"]


def test_leaks_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 5000)], "doc_id long, text string"))
    items = spark.read.parquet(f"{sf}/eval_items.parquet").unionByName(spark.createDataFrame([(9001, None, None, None, None), (9002, "...", None, None, None), (9003, "word word", None, None, None)], "item_id long, text string, benchmark_name string, scenario_family string, channel string"))
    ws = lambda t: [w for w, _, _ in leaks.normal_words(t or "")]
    want = set()
    for i in items.collect():
        w = ws(i["text"])
        grams = {" ".join(w[k : k + 15]) for k in range(max(1, len(w) - 14))} if w else set()
        for d in docs.collect():
            text = " " + " ".join(ws(d["text"])) + " "
            if any(f" {g} " in text for g in grams):
                want.add((d["doc_id"], i["item_id"]))
    got = leaks.leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and got.count() == len(want)
    small = list(leaks.blocks(items, 500))
    assert len(small) > 3 and sum(map(len, small)) == items.where("text is not null").count()
    assert leaks.leaks(docs, items.where("item_id < 0")).count() == 0


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", ("alpha money transfer " if i % 4 else "beta meeting room ") * 20) for i in range(400)] + [(1000, "c", None), (1001, None, "x y")], "doc_id long, source string, text string")
    w = spark.createDataFrame([("a", 0.4, 2), ("b", 0.35, 2), ("gone", 0.25, 3)], "source string, target_share double, max_repeats int")
    m, r = mixture.mix(docs, w)
    got = {x["source"]: x for x in r.collect()}
    assert abs(got["a"]["share_of_budget"] - 0.4) < 0.04 and abs(got["b"]["share_of_budget"] - 0.35) < 0.05
    assert got["gone"]["short"] and got["gone"]["mixture_tokens"] == 0
    assert m.where("repeats > 2 or repeats < 0").count() == 0 and m.count() == docs.count()
    assert mixture.mix(docs.where("doc_id < 0"), w)[0].count() == 0


def test_queries_against_sql(spark, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in Q.ORACLES.items():
        assert sorted(map(tuple, Q.QUERIES[name](spark, sf).collect())) == sorted(con.execute(sql).fetchall()), name


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_runs(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    assert df.count() >= 0 and df.columns


def test_prefix_join_decides(spark):
    """Cut copies that the phrase counts know nothing of: found by their longer copy,
    with another number or name and a mark of the break; not found without it."""
    words = [f"{a}{b}" for a in "ka lo mi nu pe ra so ti vu za".split() for b in "bel dor fin gam hul jik".split()]
    whole = [" ".join(words[(i * 7 + k * (i + 1)) % 60] for k in range(12)) + f" {i} for Ana today." for i in range(40)]
    part = [" ".join(t.split()[:9]).replace("Ana", "Ben") + m for t, m in zip(whole, ["", "..", " …", " ="] * 10)]
    rows = [(t, "s", "e") for t in whole + part]
    df = spark.createDataFrame(rows, "text string, src string, grp string")
    found = lambda on: {r["text"] for r in endings.with_verdict(df, "src", on).where("unfinished").collect()}
    assert not found(True) & set(whole)
    plain = {p for p in part if p[-1].isalpha()}
    assert plain <= found(True) and not plain <= found(False)


def test_long_words_and_tails():
    assert endings.tail("x" * 5000 + " a b c d e f")[-6:] == list("abcdef")
    assert endings.tail("w" * 3000 + " end") == ["w" * 3000, "end"]
    seen = {}
    for _ in range(3):
        endings.observe("the. " * 3, "e", seen)
    assert sum(v & (endings._BREAK - 1) for v in seen.values()) == 18


def test_beginnings_of_long_words(spark):
    words = spark.createDataFrame([("a" * 60 + "b", 5), ("a" * 60 + "c", 2), ("ab", 1)], "word string, n long")
    asked = spark.createDataFrame([("a" * 60,), ("a",), ("zz",)], "word string")
    got = {r["word"]: (r["longer"], r["best"]) for r in endings.prefix_counts(words, asked).collect()}
    assert got == {"a" * 60: (7, 5), "a": (8, 5)}


def test_automaton_changes_rows(spark):
    """A second reading that the vocabulary knows wins over the table form; without
    the automaton's costs (limit 0) the table form stays."""
    rows = [("a", i, "always pay always") for i in range(5)] + [("a", 10, "aІways рay"), ("a", 11, "ІD"), ("a", 12, "zІq")]
    df = spark.createDataFrame(rows, "src string, row_key long, text string")
    on = {r["row_key"]: r["text"] for r in lookalikes.unify(df, ["src", "row_key"], "text").where("changed").collect()}
    off = {r["row_key"]: r["text"] for r in lookalikes.unify(df, ["src", "row_key"], "text", 0.0).where("changed").collect()}
    assert on == {10: "always pay", 12: "zIq"} | {k: v for k, v in on.items() if k == 11}
    assert off[10] == "aIways pay"


def test_mojibake_layers():
    for pages in (["cp1252"] * 3, ["cp1252", "cp437"], ["latin-1", "cp1252"], ["mac-roman", "cp1251"]):
        text = "é"
        for p in pages:
            text = garble(text, p)
        assert any(t == "é" for _, t in mojibake.readings(text)), pages


def test_mojibake_learns_an_unknown_page(spark):
    """A page that no table has: its character is learned as a byte."""
    odd = {0xA9: "☃"}

    def garble_odd(t):
        return "".join(odd.get(b, bytes([b]).decode("latin-1")) for b in t.encode("utf-8"))

    clean = ["the café is open", "très bien", "voilà the café", "une idée"]
    rows = [("s", i, garble_odd(clean[i % 4])) for i in range(80)] + [("s", 100 + i, clean[i % 4]) for i in range(80)]
    got = {r["rec_id"]: r for r in mojibake.restore(spark.createDataFrame(rows, "src string, rec_id long, text string")).collect()}
    assert not any(got[100 + i]["garbled"] for i in range(80))
    assert all(got[i]["garbled"] for i in range(80))
    assert sum(got[i]["restored"] == clean[i % 4] for i in range(80)) >= 60


def test_sample_carries_the_short_targets(spark):
    rows = spark.range(100).select(F.col("id").alias("core_row_id"), F.lit("F").alias("scenario_family"), F.lit("c").alias("channel"), F.lit("s").alias("length_bin"))
    targets = spark.createDataFrame([(1, "f", "C", "s", 500, 5), (2, "F", "c", "S", 0, 200), (3, "g", "c", "s", 500, 0)], "target_id long, scenario_family string, channel string, length_bin string, target_permille int, min_rows int")
    chosen, report = quota_sample.sample(rows, targets, "core_row_id")
    assert chosen.count() == chosen.select("core_row_id").distinct().count() == 100
    got = {r["target_id"]: (r["n_sampled"], r["short"]) for r in report.collect()}
    assert got == {1: (100, False), 2: (100, True), 3: (0, True)}


def test_refusals_anywhere():
    opening = "Thank you for the detailed brief about the spring campaign and its many readers. " * 4
    for text in (opening + "I can't help with creating this content.", "I'm sorry, but I can't help with that request. " + opening * 3):
        assert pairs.refusal(text)
    assert not pairs.refusal(opening)


def test_mails_keep_what_is_new():
    split = mailparts.split_mail
    assert split("On 3 May 2001 10:00, John Smith wrote:\nold one\nold two\n\nMy reply is here.\n\nThanks,\nAna") == ("My reply is here.\n\nThanks,\nAna", ["quoted"])
    assert split("-----Original Message-----\nFrom: A B\nSent: 3 May\n\n> old\n\nA new paragraph.") == ("A new paragraph.", ["quoted"])
    assert split("Hi\n\nFrom: Monday we use the new gate.\nTo: reach it take stairs.\n\nMore.")[1] == []
    assert split("Hi\n\nFrom: " + "x" * 300 + "@a.example\nTo: me\n\nold") == ("Hi", ["quoted"])


def test_mails_built_from_parts():
    """Built mails: any sequence of replies below quotes gives back the new paragraphs."""
    import random

    rnd = random.Random(5)
    for _ in range(300):
        lines, want = [], []
        for i in range(rnd.randint(1, 60)):
            if rnd.random() < 0.5:
                depth = rnd.randint(1, 6)
                head = rnd.choice([["On 3 May 2001 10:00, A B wrote:"], ["-----Original Message-----", "From: A B", "Sent: 3 May 2001"], []])
                lines += [*head, *(["> " * depth + f"old text {i}."] * rnd.randint(1, 3)), ""]
            else:
                want.append(f"New sentence {i} of the sender, which stays.")
                lines += [want[-1], ""]
        assert mailparts.split_mail("\n".join(lines))[0].strip().split("\n\n") == (want or [""])


def test_mail_grammar_is_linear():
    import time

    for block in (["short line"] * 1600 + ["this is a sentence."], ["Short Line"] * 1600):
        mailparts.split_mail("warm up")
        began = time.process_time()
        mailparts.split_mail("\n".join(block))
        assert time.process_time() - began < 1.0


def test_classifier_chooses_documents(spark):
    """With the classifier, documents that look like the lacking domain are used more."""
    text = {"a": "alpha money transfer ", "b": "beta meeting room "}
    rows = [(i, "a", text["a" if i % 2 else "b"] * 20) for i in range(200)] + [(1000 + i, "b", text["b"] * 20) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    w = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    used = {}
    for on in (True, False):
        m = mixture.mix(docs, w, classify=on)[0].where("source = 'a'").collect()
        used[on] = [sum(r["repeats"] for r in m if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert abs(used[False][0] - used[False][1]) < 30 and used[True] != used[False]


def test_leaks_anchors():
    words = [f"w{i}" for i in range(60)]
    found = leaks.Passages(((1, " ".join(words)), (2, "short item"), (3, " ".join(words[:14]))), 15)
    for a in range(46):
        text = "x y " + " ".join(words[a : a + 15]) + " z"
        assert found.scan(text)[1] == (4, len(text) - 2), a
        assert 1 not in found.scan("x " + " ".join(words[a : a + 14]) + " z")
    assert set(found.scan("a Short  ITEM b")) == {2} and 3 in found.scan(" ".join(words[:14]))


def test_tokens_of_ascii_and_other_texts_agree():
    text = "Pay US$12.50, $3 or 45% by 10:30!\n\nIt's state-of-the-art [URL] (x1 2a) \x1c \t end."
    assert endings.tokens(text) == endings.TOKEN.findall(text)


def test_short_texts_propose_few_pairs(spark):
    """300 train and 300 evaluation texts over one vocabulary: most of the 90,000 pairs
    meet under a pair of words, few are moved, and triples of words lose none."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [rng.choices(vocabulary, k=rng.randint(1, 40)) for _ in range(500)]
    for t in texts[:100]:  # near copies
        t = [w for w in t if rng.random() > 0.08] or t
        texts.append([rng.choice(vocabulary) if rng.random() < 0.08 else w for w in t])
    side = [rng.random() < 0.5 for _ in texts]
    df = spark.createDataFrame([(i, "train" if s else "val", " ".join(t)) for i, (t, s) in enumerate(zip(texts, side))], "key long, split string, text string")
    cls = overlap.prepare(df, "key").withColumnRenamed("key", "id").cache()
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if side[i] and not side[j] and overlap.near_same(a, b)}
    assert len(want) > 20
    for hot in ({}, {"hot_pairs": 0, "least": 1}, {"sample": 100, "least": 2}):
        keys = overlap.word_offers(cls, **hot)
        assert overlap.word_candidates(keys).count() < 5_000
        assert want <= {(r.a, r.b) for r in overlap.word_pairs(keys, cls).collect()}


def test_rates_use_whole_posteriors():
    """The third domain's weight counts too: two documents alike in their two likeliest
    domains get other rates."""
    p = np.array([[0.5, 0.3, 0.2, 0.0], [0.5, 0.3, 0.0, 0.2]] * 20)
    tokens, source = np.full(40, 100.0), np.zeros(40, int)
    soft, hard = tokens @ p, np.bincount(source, tokens, 4)
    r = mixture.fit(tokens, p, source, np.full(4, 3.0), np.array([2000.0, 1200.0, 600.0, 200.0]), soft, hard, 300)
    assert r[0] > r[1] + 0.1 and np.allclose(r[::2], r[0])


def test_mixture_blocks(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], f"{'money room cup'.split()[(i * 7) % 3]} word{i % 11} talk " * 10) for i in range(600)], "doc_id long, source string, text string")
    counted = mixture.count_tokens(docs).cache()
    place, caps = {"a": 0, "b": 1, "c": 2}, np.full(3, 2.0)
    member = mixture.memberships(counted, mixture.train(counted, list(place)), 0.5).cache()
    total = member.agg(F.sum("n_tokens")).first()[0]
    targets = np.array([0.5, 0.3, 0.2]) * total
    for block in (1000, 100):
        fitted = mixture.rates(member, place, caps, targets, 300, True, block).cache()
        shift = mixture.shifts(fitted, place, caps, targets)
        got = [0.0] * 3
        for x in fitted.collect():
            got[place[x.source]] += x.n_tokens * min(2.0, max(0.0, x.r + shift[place[x.source]]))
        assert np.allclose(got, targets, rtol=1e-6) and fitted.count() == 600
