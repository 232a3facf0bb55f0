"""Operators: edge cases, invariance to partitioning, brute force."""

import io
import os
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators import checks, joins, ml, neardup, sampling, stats, windows
from corpusloom.sources import readers, sinks


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None, i % 2) for i in range(200)], "id long, g string, label int")


def test_ordinal(people):
    for df in (people, people.repartition(7), people.where("id < 0")):
        got = sorted((r["id"], r["n"]) for r in windows.ordinal(df, "id", "n").collect())
        assert got == [(i, i + 1) for i in range(df.count())]


def test_seeded_rank_is_stable(people):
    a = {r["id"]: r["r"] for r in windows.seeded_rank(people, ["g"], 1, "id", "r").collect()}
    b = {r["id"]: r["r"] for r in windows.seeded_rank(people.repartition(11), ["g"], 1, "id", "r").collect()}
    assert a == b and len(a) == 200
    sizes = {}
    for r in people.collect():
        sizes.setdefault(r["g"], []).append(a[r["id"]])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in sizes.values())


def test_downsample_quotas(people):
    some = people.where("g is not null")
    got = sampling.downsample(some, 30, ["g"], "id", 5)
    assert got.count() == 30
    assert sampling.downsample(some, 1000, ["g"], "id", 5).count() == some.count()
    assert sampling.downsample(some, 0, ["g"], "id", 5).count() == 0


@pytest.mark.parametrize("n,want", [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 0, 1)), (3, (2, 1, 0)), (8, (6, 1, 1)), (3000, (2250, 450, 300)), (852, (639, 127, 86)), (786, (589, 117, 80))])
def test_split_sizes(spark, n, want):
    r = spark.range(1).select(*sampling.split_sizes(F.lit(n))).first()
    assert tuple(r) == want


def test_match_tiers_uses_each_once(spark):
    l = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "p"), (4, None, "p")], "id long, a string, b string")
    r = spark.createDataFrame([(11, "x", "q"), (12, "x", "z"), (13, "y", "p")], "id long, a string, b string")
    got = joins.match_tiers(l, r, "id", [["a", "b"], ["a"]]).collect()
    assert {(x["left_id"], x["right_id"], x["tier"]) for x in got} == {(2, 11, 0), (3, 13, 0), (1, 12, 1)}


def test_mann_whitney_brute_force(spark):
    rows = [(i % 2, float((i * 7) % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "label int, x double")
    r = stats.mann_whitney(stats.long_form(df, ["x"], "label")).first()
    one, zero = [x for l, x in rows if l == 1], [x for l, x in rows if l == 0]
    assert r["u1"] == sum((a > b) + 0.5 * (a == b) for a in one for b in zero)
    m = stats.rank_metrics(df.withColumn("g", F.lit(1)), ["g"], "label", "x").first()
    assert m["roc_auc"] == pytest.approx(r["auc"])
    none = stats.rank_metrics(df.where("label = 1").withColumn("g", F.lit(1)), ["g"], "label", "x").first()
    assert none["roc_auc"] is None and none["average_precision"] == pytest.approx(1.0)


def test_near_duplicates_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    texts = [" ".join(base), " ".join(base + ["tail"]), " ".join(base), " ".join(base[::-1]), None, "", "short", "short", " ".join(base + ["tail", "more"])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {}
    for i, t in enumerate(texts):
        if t:
            w = t.split()
            sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in neardup.classes(df, "id", "text").collect()}
    assert set(got) == set(sets)
    for i in sets:
        distinct = {frozenset(s) for j, s in sets.items() if s != sets[i] and len(s & sets[i]) / len(s | sets[i]) >= 0.8}
        assert got[i][1] == len(distinct)
    assert got[0][0] == got[1][0] == got[2][0] == got[8][0] == 0 and got[3][0] == 3 and got[6][0] == got[7][0] == 6
    assert neardup.classes(df.where("id < 0"), "id", "text").count() == 0


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, t string")
    r = checks.row_checks(df, [("no_null", "error", F.col("t").isNull()), ("fine", "warning", F.col("id") < 0)])
    assert {x["name"]: (x["n_bad"], x["ok"]) for x in r.collect()} == {"no_null": (1, False), "fine": (0, True)}
    with pytest.raises(checks.CheckFailed):
        checks.enforce(r)
    checks.enforce(r.where("name = 'fine'"), strict=True)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("sms", "ham\thello\nspam\twin\tnow\nbroken\n")
    assert {(r["label"], r["text"]) for r in readers.zipped_tsv(spark, str(tmp_path / "a.zip")).collect()} == {("ham", "hello"), ("spam", "win\tnow")}
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        data = b"Subject: hi\n\nbody"
        info = tarfile.TarInfo("mail/ham/1.txt")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    r = readers.tarred(spark, str(tmp_path / "b.tar.gz")).first()
    assert (r["folder"], readers.body(bytes(r["content"]))[3]) == ("ham", "body")


def test_mbox(spark, tmp_path):
    raw = b"From a@b Thu Jan 1\nSubject: one\nContent-Type: text/html; charset=x-unknown\n\n<html><head><title>t</title></head><p>Hi &amp; bye</p><script>x</script></html>\n\nFrom c@d Fri Jan 2\nSubject: two\n\nplain\n>From here\n"
    (tmp_path / "m.mbox").write_bytes(raw)
    r = readers.mbox(spark, str(tmp_path / "m.mbox")).orderBy("position").collect()
    assert [x["subject"] for x in r] == ["one", "two"]
    assert r[0]["text"] == "Hi & bye" and r[1]["text"].strip() == "plain\nFrom here"
    assert readers.mbox_by_regex(spark, str(tmp_path / "m.mbox")).count() == 2


def test_embedded_csv_and_prompts(spark):
    df = spark.createDataFrame([(1, 'id,text\nA-7,"x, y"\n8,z\n\n')], "k int, t string")
    got = {(r["id"], r["text"]) for r in readers.embedded_csv(df, "k", "t", ["id", "text"]).collect()}
    assert got == {("7", "x, y"), ("8", "z")}
    assert readers.prompt_blocks("a\n===\n\n b \n====\n") == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        readers.exactly_one(["a", "b"], "lane")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")]), (2, 2.0, None)], "id int, x double, v array<double>")
    path = os.path.join(tmp_path, "j")
    sinks.jsonl(df, path)
    got = {r["id"]: (r["x"], r["v"]) for r in readers.jsonl(spark, path, df.schema).collect()}
    assert got == {1: (None, [1.0, None]), 2: (2.0, None)}
    doc = sinks.replace_block("# T", "b", "one")
    assert sinks.replace_block(sinks.replace_block(doc, "b", "two"), "b", "two").count("two") == 1
    assert '"a.x"' not in sinks.merge_manifest({"checks": [{"name": "a.x"}]}, {}, [{"name": "a.y"}], "a.")


def test_nearest_by_ties(spark):
    """Several rows of one size are all candidates; the least keys come first."""
    pool = spark.createDataFrame([("a", i, n) for i, n in [(1, 10), (2, 10), (3, 10), (4, 12), (5, 8), (6, 8), (7, 20)]], "g string, id long, s int")
    probes = spark.createDataFrame([("a", 0, 10), ("a", 1, 13), ("a", 2, 9), ("a", 3, 7), ("a", 4, 16), ("b", 5, 10)], "g string, p long, s int")
    rows = [tuple(x) for x in pool.collect()]
    want = set()
    for g, p, s in probes.collect():
        near = sorted((abs(n - s), n, i) for h, i, n in rows if h == g)[:2]
        want |= {(p, i, d, r + 1) for r, (d, _, i) in enumerate(near)}
    got = joins.nearest_by(probes, pool, ["g"], "p", "id", "s").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_cut_leaves_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (files.apply(i).getName() for i in range(files.size())) if x.startswith("shuffle_")}

    before = shuffles()
    out = session.cut(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count())
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert len(out.collect()) == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_experiments_count_terms_once(spark, monkeypatch):
    rows = [(i % 2, float(i % 5), [f"w{i % 7}", f"w{(i + i % 2) % 3}", "x"][: i % 4]) for i in range(240)]
    df = spark.createDataFrame(rows, "label int, a double, words array<string>")
    train, val = df.where("a < 3"), df.where("a >= 3")
    models, sets = ["lr_l2_c1", "sgd_log"], {"a": ["a"], "words": ["words"], "both": ["a", "words"]}
    alone = {}
    for m in models:
        for b, features in sets.items():
            model, _ = ml.fit(train, m, features)
            alone[m, b] = float(ml.evaluate(ml.predict(model, val).withColumn("_all", F.lit(1)), ["_all"], m).first()["f1"] or 0.0)
    fits, fit = [], ml.CountVectorizer._fit
    monkeypatch.setattr(ml.CountVectorizer, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    done = ml.best_experiment(train, val, models, sets)
    assert len(fits) == 1
    assert {(d["model"], d["features"]): d["f1"] for d in done} == pytest.approx(alone) and len(set(alone.values())) > 1
    assert [d["f1"] for d in done] == sorted(alone.values(), reverse=True)
    assert ml.predict(done[0]["fitted"], val).where("score is not null").count() == val.count()
    again = ml.fit_terms(train, "lr_l2_c1", sets["both"])
    want = next(d for d in done if (d["model"], d["features"]) == ("lr_l2_c1", "both"))["fitted"]
    a, b = ([r["score"] for r in ml.predict(m, val).orderBy("a", "words").collect()] for m in (again, want))
    assert a == pytest.approx(b, abs=1e-6)


def test_experiments_without_rows_of_val(spark):
    df = spark.createDataFrame([(i % 2, float(i % 5)) for i in range(40)], "label int, a double")
    done = ml.best_experiment(df, df.where("a < 0"), ["sgd_log"], {"a": ["a"]})
    assert [d["f1"] for d in done] == [0.0]
