"""Queries over sources, sinks (S, K) and streams: written, then read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.q_text import q
from corpusloom.plans.registry import Tables, query
from corpusloom.session import remove_at_exit, shared_folder
from corpusloom.sources import readers as R
from corpusloom.sources import sinks as K
from corpusloom.streaming import incremental as I


def _folder(t: Tables, name: str) -> str:
    return remove_at_exit(t.spark, shared_folder(t.spark, name))


GEN = "gen_id, text, label, token_count"


@query("s1_jsonl_round_trip", f"SELECT {GEN} FROM llm_mass_generation")
def s1_jsonl_round_trip(t: Tables) -> DataFrame:
    """Line JSON with nulls and non-ASCII characters kept."""
    df, path = t("llm_mass_generation").select("gen_id", "text", "label", "token_count"), _folder(t, "s1")
    K.jsonl(df, path)
    return R.jsonl(t.spark, path, df.schema)


@query("s2_jsonl_tolerant", "SELECT gen_id, label, CAST(1 AS BIGINT) AS n_bad FROM llm_mass_generation")
def s2_jsonl_tolerant(t: Tables) -> DataFrame:
    """Broken lines among good ones are left out and counted."""
    df, path = t("llm_mass_generation").select("gen_id", "label"), _folder(t, "s2")
    df.select(F.to_json(F.struct("gen_id", "label")).alias("value")).unionByName(t.spark.createDataFrame([("{broken",), ("",)], "value string")).write.text(path)
    good, bad = R.jsonl_tolerant(t.spark, path, df.schema)
    return good.crossJoin(F.broadcast(bad))  # the count is one row


@query("s3_jsonl_provenance", "SELECT rec_id, text, row_number() OVER (ORDER BY rec_id) AS provenance_line_no FROM smishtank_prepared")
def s3_jsonl_provenance(t: Tables) -> DataFrame:
    """Rows with their line in the file they stand in, which is written in order."""
    df, path = t("smishtank_prepared").select("rec_id", "text"), _folder(t, "s3")
    K.jsonl(df.coalesce(1).sortWithinPartitions("rec_id"), path)
    return R.jsonl_with_provenance(t.spark, path, df.schema).select("rec_id", "text", F.col("provenance_line_no").cast("long").alias("provenance_line_no"))


@query("s5_one_file_per_lane", "SELECT 'human' AS lane, gen_id FROM llm_mass_generation WHERE label = 0 UNION ALL SELECT 'llm', gen_id FROM llm_mass_generation WHERE label = 1")
def s5_one_file_per_lane(t: Tables) -> DataFrame:
    """Each lane is read from the one file it must have."""
    out = None
    for lane, label in (("human", 0), ("llm", 1)):
        df, path = t("llm_mass_generation").where(F.col("label") == label).select("gen_id"), _folder(t, "s5")
        K.jsonl(df.coalesce(1), path)
        files = t.spark.read.schema(df.schema).json(path).inputFiles()
        part = R.jsonl(t.spark, R.exactly_one(list(files), lane), df.schema).select(F.lit(lane).alias("lane"), "gen_id") if files else df.select(F.lit(lane).alias("lane"), "gen_id").limit(0)
        out = part if out is None else out.unionByName(part)
    return out


@query("s4_tagged_files", "SELECT core_eval_slice, count(*) AS n FROM core_records GROUP BY 1")
def s4_tagged_files(t: Tables) -> DataFrame:
    """One folder per slice, the slice read back from the path (also K5)."""
    df, path = t("core_records").select("core_row_id", "core_eval_slice"), _folder(t, "s4")
    df.write.partitionBy("core_eval_slice").json(path)
    schema = df.select("core_row_id").schema
    r = t.spark.read.option("recursiveFileLookup", "true").schema(schema).json(path).withColumn("core_eval_slice", F.regexp_extract("_metadata.file_path", r"core_eval_slice=([^/]+)/", 1))
    return r.groupBy("core_eval_slice").agg(F.count("*").alias("n"))


@query("s6_csv_round_trip", "SELECT CAST(rec_id AS VARCHAR) AS rec_id, coalesce(text, '') AS text FROM smishtank_prepared")
def s6_csv_round_trip(t: Tables) -> DataFrame:
    """Strings with line breaks, quotes and commas; empty fields stay empty."""
    df, path = t("smishtank_prepared").select("rec_id", F.coalesce("text", F.lit("")).alias("text")), _folder(t, "s6")
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return R.csv_strings(t.spark, path)


@query("s7_csv_latin1", "SELECT CAST(rec_id AS VARCHAR) AS rec_id, regexp_replace(coalesce(text, ''), '[^\\x{00}-\\x{ff}]', '?', 'g') AS text FROM mendeley_smishing_prepared")
def s7_csv_latin1(t: Tables) -> DataFrame:
    """All strings, in the older encoding; nothing is read as missing."""
    df, path = t("mendeley_smishing_prepared").select("rec_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x{00}-\x{ff}]", "?").alias("text")), _folder(t, "s7")
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("encoding", "ISO-8859-1").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return R.csv_strings(t.spark, path, "ISO-8859-1")


_S8 = "SELECT gen_id, label FROM llm_mass_generation"


@query("s8_parquet_any", f"SELECT 'splits' AS way, * FROM ({_S8}) UNION ALL SELECT 'single', * FROM ({_S8}) UNION ALL SELECT 'csv', * FROM ({_S8})")
def s8_parquet_any(t: Tables) -> DataFrame:
    """Three files, one file or a CSV, whichever is there."""
    df = t("llm_mass_generation").select("gen_id", "label")
    part = F.pmod(F.xxhash64("gen_id"), F.lit(3))
    out = None
    for way in ("splits", "single", "csv"):
        path = _folder(t, "s8")
        if way == "splits":
            for n, name in enumerate(("train", "val", "test")):
                K.parquet(df.where(part == n), f"{path}/{name}.parquet")
        elif way == "single":
            K.parquet(df, f"{path}/data.parquet")
        else:
            df.write.option("header", True).csv(f"{path}/data.csv")
        r = R.parquet_any(t.spark, path, lambda p: R.exists(t.spark, p)).select(F.lit(way).alias("way"), "gen_id", F.col("label").cast("int").alias("label"))
        out = r if out is None else out.unionByName(r)
    return out


_LINE = "[\\n\\r\\t]+"


@query("s9_zipped_tsv", f"SELECT CAST(rec_id AS VARCHAR) AS label, regexp_replace(text, '{_LINE}', ' ', 'g') AS text FROM mendeley_smishing_prepared WHERE text IS NOT NULL")
def s9_zipped_tsv(t: Tables) -> DataFrame:
    """``label<TAB>text`` lines of zip members."""
    path = _folder(t, "s9")
    line = F.concat_ws("\t", F.col("rec_id").cast("string"), F.regexp_replace("text", _LINE, " "))
    rows = t("mendeley_smishing_prepared").where("text is not null").groupBy(F.pmod(F.xxhash64("rec_id"), F.lit(64)).alias("m")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    K.archives(rows.select(F.concat(F.lit("m"), "m", F.lit(".tsv")).alias("member"), "content"), path, "zip")
    return R.zipped_tsv(t.spark, path).select("label", "text")


@query("s10_tarred", "SELECT coalesce(lang, 'none') AS folder, doc_id, text FROM documents WHERE text IS NOT NULL")
def s10_tarred(t: Tables) -> DataFrame:
    """Members of tar archives, the folder as the class."""
    path = _folder(t, "s10")
    d = t("documents").where("text is not null").select(F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.col("text").alias("content"))
    K.archives(d.repartition(t.spark.sparkContext.defaultParallelism), path, "tar.gz")
    return R.tarred(t.spark, path).select("folder", F.regexp_extract("member", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


_TRIM = "regexp_replace({}, '^[\\s]+|[\\s]+$', '', 'g')"
_STRIP = r"^\s+|\s+$"


def _mails(t: Tables, message: Column, path: str) -> None:  # noqa: ANN001
    """Messages as an mbox; lines that look like its separator are quoted."""
    safe = F.regexp_replace(message, r"(?md)^(>*From )", ">$1")
    t("nigerian_fraud_prepared").where("raw_body is not null").select(F.concat(F.lit("From x@example Thu Jan  1 00:00:00 2001\n"), safe).alias("value")).write.text(path)


def _part(kind: str, charset: str, content) -> Column:  # noqa: ANN001
    return F.concat(F.lit(f"Content-Type: {kind}; charset={charset}\nContent-Transfer-Encoding: 8bit\n\n"), content)


def _two_parts() -> Column:
    """A plain part with the body and an HTML part with the id."""
    head = F.concat(F.lit("Subject: "), F.col("rec_id").cast("string"), F.lit("\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=frontier9\n\n--frontier9\n"))
    page = F.concat(F.lit("<html><style>p {}</style><body><p>Page "), F.col("rec_id").cast("string"), F.lit("</p></body></html>"))
    return F.concat(head, _part("text/plain", "utf8", F.col("raw_body")), F.lit("\n--frontier9\n"), _part("text/html", "utf-8", page), F.lit("\n--frontier9--\n"))


@query("s11_mbox", f"SELECT CAST(rec_id AS VARCHAR) AS subject, {_TRIM.format('raw_body')} AS text FROM nigerian_fraud_prepared WHERE raw_body IS NOT NULL")
def s11_mbox(t: Tables) -> DataFrame:
    """Single-part messages of an mbox."""
    path = _folder(t, "s11")
    _mails(t, F.concat(F.lit("Subject: "), F.col("rec_id").cast("string"), F.lit("\n"), _part("text/plain", "utf-8", F.col("raw_body"))), path)
    return R.mbox(t.spark, path).select("subject", F.regexp_replace("text", _STRIP, "").alias("text"))


@query("s13_all_bodies", f"SELECT CAST(rec_id AS VARCHAR) AS subject, trim({_TRIM.format('raw_body')} || ' Page ' || rec_id) AS text FROM nigerian_fraud_prepared WHERE raw_body IS NOT NULL")
def s13_all_bodies(t: Tables) -> DataFrame:
    """All text parts, plain before HTML, joined."""
    path = _folder(t, "s13")
    _mails(t, _two_parts(), path)
    text = F.regexp_replace(F.regexp_replace("text", _STRIP, ""), r"\s+(Page \d+)$", " $1")
    return R.mbox(t.spark, path, prefer_plain=False).select("subject", text.alias("text"))


@query("s14_plain_body", f"SELECT CAST(rec_id AS VARCHAR) AS subject, {_TRIM.format('raw_body')} AS text FROM nigerian_fraud_prepared WHERE raw_body IS NOT NULL")
def s14_plain_body(t: Tables) -> DataFrame:
    """The plain part wins over the HTML part."""
    path = _folder(t, "s14")
    _mails(t, _two_parts(), path)
    return R.mbox(t.spark, path).select("subject", F.regexp_replace("text", _STRIP, "").alias("text"))


@query("s15_charset_aliases", "SELECT CAST(rec_id AS VARCHAR) AS subject, 'Page ' || rec_id AS text FROM nigerian_fraud_prepared WHERE raw_body IS NOT NULL")
def s15_charset_aliases(t: Tables) -> DataFrame:
    """HTML only, under a charset name that needs its alias."""
    path = _folder(t, "s15")
    page = F.concat(F.lit("<html><head><title>t</title></head><p>Page "), F.col("rec_id").cast("string"), F.lit("</p><script>x()</script></html>"))
    _mails(t, F.concat(F.lit("Subject: "), F.col("rec_id").cast("string"), F.lit("\n"), _part("text/html", "ansi", page)), path)
    return R.mbox(t.spark, path).select("subject", F.regexp_replace("text", _STRIP, "").alias("text"))


@query("s20_first_that_works", "SELECT gen_id FROM llm_mass_generation")
def s20_first_that_works(t: Tables) -> DataFrame:
    """A missing mirror, one with another schema that fails only when it is read, then the data."""
    path = _folder(t, "s20")
    t("llm_mass_generation").select("gen_id").write.parquet(path)
    lazy = lambda: t.spark.read.parquet(path).select(F.raise_error(F.lit("broken mirror")).cast("string").alias("gen_id"))
    return R.first_that_works([lambda: t.spark.read.parquet(f"{path}-gone"), lazy, lambda: t.spark.read.parquet(path)])


@query("s22_embedded_csv", "SELECT gen_id, CAST(n AS VARCHAR) AS id, 'line ' || n || ', quoted' AS text FROM llm_mass_generation, (VALUES (1), (2)) v(n)")
def s22_embedded_csv(t: Tables) -> DataFrame:
    """CSV inside a column, with a header line and quoted commas."""
    csv = F.lit('id,text\n1,"line 1, quoted"\n\n2,"line 2, quoted"')
    return R.embedded_csv(t("llm_mass_generation").select("gen_id", csv.alias("response")), "gen_id", "response", ["id", "text"]).select("gen_id", "id", "text")


@query("s23_prompt_files", f"SELECT DISTINCT {_TRIM.format('prompt_text')} AS block FROM llm_mass_generation WHERE prompt_text IS NOT NULL AND {_TRIM.format('prompt_text')} <> ''")
def s23_prompt_files(t: Tables) -> DataFrame:
    """Prompts between separator lines."""
    path = _folder(t, "s23")
    t("llm_mass_generation").where("prompt_text is not null").select(F.concat(F.lit("=====\n"), "prompt_text").alias("value")).distinct().write.text(path)
    return R.prompt_files(t.spark, path).select("block").distinct()


@query("s8_parquet_round_trip", "SELECT doc_id, source, n_chars FROM documents")
def s8_parquet_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "s8")
    K.parquet(t("documents").select("doc_id", "n_chars", "source"), path, ["source"])
    return t.spark.read.parquet(path).select("doc_id", "source", "n_chars")


@query("s12_mbox_by_regex", f"SELECT {_TRIM.format('raw_body')} AS text FROM nigerian_fraud_prepared WHERE raw_body IS NOT NULL")
def s12_mbox_by_regex(t: Tables) -> DataFrame:
    """Bodies written as an mbox and split again at their ``From `` lines."""
    path = _folder(t, "s12")
    _mails(t, F.concat(F.lit("Subject: -\n\n"), "raw_body"), path)
    back = F.regexp_replace("text", r"(?md)^>(>*From )", "$1")
    return R.mbox_by_regex(t.spark, path).select(F.regexp_replace(back, _STRIP, "").alias("text"))


@query("s18_explode_answers", "SELECT question_id, role, text FROM (SELECT question_id, CASE WHEN label = 0 THEN 'human' ELSE 'chatgpt' END AS role, text FROM core_records WHERE question_id IS NOT NULL) WHERE trim(text) <> ''")
def s18_explode_answers(t: Tables) -> DataFrame:
    """Answers gathered per question, then one row an answer again."""
    side = lambda n: F.collect_list(F.when(F.col("label") == n, F.col("text")))
    raw = t("core_records").where("question_id is not null").groupBy(F.col("question_id").cast("string").alias("question")).agg(side(0).alias("human_answers"), side(1).alias("chatgpt_answers"))
    return R.explode_answers(raw).select(F.col("question").cast("long").alias("question_id"), "role", "text")


@query("s24_pending_scores", "SELECT core_row_id FROM core_records WHERE label IS DISTINCT FROM 1 OR length_bin IS NULL OR token_length IS NULL")
def s24_pending_scores(t: Tables) -> DataFrame:
    """The cache holds the generated rows, some without one of their scores."""
    r, path = t("core_records"), _folder(t, "s24")
    r.where("label = 1").select("core_row_id", F.when(F.col("length_bin").isNotNull(), F.col("char_length")).alias("nll"), F.col("token_length").alias("ppl")).write.parquet(path)
    return R.pending_scores(r.select("core_row_id"), t.spark.read.parquet(path), "core_row_id", ["nll", "ppl"]).select("core_row_id")


@query("s25_collect_counts", " UNION ALL ".join(f"SELECT {q(n)} AS source, count(*) AS n FROM {n}" for n in ("enron_ham_annotated", "nigerian_fraud_prepared", "smishtank_prepared", "mendeley_smishing_prepared")))
def s25_collect_counts(t: Tables) -> DataFrame:
    parts = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("source"), "n") for n in ("enron_ham_annotated", "nigerian_fraud_prepared", "smishtank_prepared", "mendeley_smishing_prepared")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("k2_finite", "SELECT event_id, CASE WHEN value < 1 THEN NULL ELSE value END AS value FROM events")
def k2_finite(t: Tables) -> DataFrame:
    """Not-a-number and infinities become null."""
    return K.finite(t("events").select("event_id", F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")))


@query("k3_append_new", "SELECT gen_id, label FROM llm_mass_generation")
def k3_append_new(t: Tables) -> DataFrame:
    """Appending the same rows again adds nothing."""
    df, path = t("llm_mass_generation").select("gen_id", "label"), _folder(t, "k3")
    K.append_new(df.where("label = 0"), path, "gen_id", df.schema)
    K.append_new(df, path, "gen_id", df.schema)
    K.append_new(df, path, "gen_id", df.schema)
    return R.jsonl(t.spark, path, df.schema)


@query("k6_csv_table", "SELECT channel, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY 1")
def k6_csv_table(t: Tables) -> DataFrame:
    """A count table as one CSV file, read back."""
    path = _folder(t, "k6")
    K.csv_table(t("documents").groupBy("channel").agg(F.count("*").alias("n")), path)
    return t.spark.read.option("header", True).csv(path)


@query("k7_report", "SELECT '| ' || split || ' | ' || n || ' |' AS line FROM (SELECT lower(trim(split)) AS split, count(*) AS n FROM core_records WHERE split IS NOT NULL GROUP BY 1)")
def k7_report(t: Tables) -> DataFrame:
    """A table rendered into a report's block, twice; its lines appear once."""
    rows = t("core_records").where("split is not null").groupBy(F.lower(F.trim("split")).alias("split")).agg(F.count("*").alias("n"))
    table_ = K.markdown(rows)
    report = K.replace_block(K.replace_block("# Report", "splits", "old"), "splits", table_)
    report = K.replace_block(report, "splits", table_)
    lines = [(x,) for x in report.split("\n") if x.startswith("| ") and not x.startswith("| split")]
    return t.spark.createDataFrame(lines, "line string")


@query("k8_manifest", "SELECT lower(trim(split)) AS name, count(*) AS n FROM core_records WHERE split IS NOT NULL GROUP BY 1")
def k8_manifest(t: Tables) -> DataFrame:
    """Checks of an earlier run are replaced by prefix when a manifest is merged."""
    rows = t("core_records").where("split is not null").groupBy(F.lower(F.trim("split")).alias("s")).agg(F.count("*").alias("n")).collect()
    old = {"made": "before", "checks": [{"name": "split:gone", "n": 1}]}
    text = K.merge_manifest(old, {"made": "now"}, [{"name": f"split:{r.s}", "n": r.n} for r in rows], "split:")
    got = t.spark.createDataFrame([(text,)], "text string").select(F.explode(F.from_json("text", "checks array<struct<name:string,n:long>>")["checks"]).alias("c"))
    return got.select(F.expr("substring(c.name, 7)").alias("name"), "c.n")


@query("v34_reload_equality", "SELECT lower(trim(split)) AS split, label, count(*) AS n_before, count(*) AS n_after FROM core_records GROUP BY 1, 2")
def v34_reload_equality(t: Tables) -> DataFrame:
    """Rows per split and label before and after the splits were written."""
    r, path = t("core_records").select(F.lower(F.trim("split")).alias("split"), "label"), _folder(t, "v34")
    K.parquet(r, path, ["split"])
    count = lambda d, n: d.groupBy("split", "label").agg(F.count("*").alias(n))
    a, b = count(r, "n_before"), count(t.spark.read.schema(r.schema).parquet(path), "n_after")
    same = a["split"].eqNullSafe(b["split"]) & a["label"].eqNullSafe(b["label"])
    return a.join(b, same, "full").select(F.coalesce(a["split"], b["split"]).alias("split"), F.coalesce(a["label"], b["label"]).alias("label"), "n_before", "n_after")


@query("stream_append_new", "SELECT DISTINCT gen_id FROM llm_mass_generation")
def stream_append_new(t: Tables) -> DataFrame:
    """A file stream appended by key, run twice; the second run adds nothing."""
    path, out = _folder(t, "stream-in"), _folder(t, "stream-out")
    df = t("llm_mass_generation").select("gen_id", "text")
    state = remove_at_exit(t.spark, f"{out}-state")
    for _ in range(2):  # the second delivery repeats every row
        df.write.mode("append").parquet(path)
        I.append_new_keys(I.files(t.spark, path, df.schema), "gen_id", out, state).awaitTermination()
    return t.spark.read.parquet(out).select("gen_id")


@query("stream_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    """Hourly counts per event type from a file stream, open windows included."""
    path, out = _folder(t, "windows-in"), _folder(t, "windows-out")
    df = t("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    df.write.parquet(path)
    # Rows come in any order here, so the watermark allows for the whole span.
    r = I.tumbling(I.files(t.spark, path, df.schema), "ts", "1 hour", "36500 days", "event_type")
    I.written_windows(r.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"), out, remove_at_exit(t.spark, f"{out}-state")).awaitTermination()
    return I.latest(t.spark, out, ["hour", "event_type"], "n")
