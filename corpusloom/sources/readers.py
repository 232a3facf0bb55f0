"""Readers of message corpora: line JSON, CSV, Parquet, mail archives.

Line-oriented formats use Spark's scans. Archives (zip, tar, mbox) are read one
file a task and stream their members out in batches, so a file, not the corpus,
bounds a task; corrupt members are skipped and counted, not fatal.
"""

from __future__ import annotations

import email
import email.policy
import html.parser
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 512


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Line JSON with a declared schema; blank lines do not count."""
    return spark.read.schema(schema).json(path)


def jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, number of bad lines). The scan does not answer questions about its
    bad lines alone, so the count reads a column of the schema, too."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad is null").drop("_bad"), raw.agg(F.count_if(F.col("_bad").isNotNull() & (F.xxhash64(schema[0].name) != 0)).alias("n_bad"))


def jsonl_with_provenance(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows with their file name and one-based line number, blank lines counted.

    Each file is one record of a whole-text read, so its lines keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("provenance_source_file"), F.posexplode(F.split("value", "\n")).alias("_p", "_line"))
    parsed = lines.where(F.trim("_line") != "").select("provenance_source_file", (F.col("_p") + 1).alias("provenance_line_no"), F.from_json("_line", schema).alias("_r"))
    return parsed.select("_r.*", "provenance_source_file", "provenance_line_no")


def tagged(spark: SparkSession, paths: list[str], schema: T.StructType, pattern: str) -> DataFrame:
    """Files in sorted order with a group taken from their path."""
    return spark.read.schema(schema).json(sorted(paths)).withColumn("group", F.regexp_extract("_metadata.file_path", pattern, 1))


def exactly_one(paths: list[str], what: str) -> str:
    """The only path of a lane; anything else is an error."""
    if len(paths) != 1:
        raise FileNotFoundError(f"{what}: expected one file, found {len(paths)}")
    return paths[0]


def csv_strings(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings, empty ones kept, bad lines dropped."""
    return spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, mode="DROPMALFORMED", multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="")


def parquet_any(spark: SparkSession, folder: str, exists: Callable[[str], bool]) -> DataFrame:
    """train/val/test files, else one file, else a CSV."""
    split = [f"{folder}/{s}.parquet" for s in ("train", "val", "test")]
    if all(map(exists, split)):
        return spark.read.parquet(*split)
    if exists(f"{folder}/data.parquet"):
        return spark.read.parquet(f"{folder}/data.parquet")
    return csv_strings(spark, f"{folder}/data.csv")


def _members(df: DataFrame, members: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = T._parse_datatype_string(schema).fieldNames()

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows: list[tuple] = []
                for row in members(path, content):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(go, schema)


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zipped_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``label<TAB>text`` lines of every member of zip files."""

    def members(_: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                with z.open(name) as lines:  # streamed: a member is never whole in memory
                    for line in lines:
                        label, tab, text = line.decode("utf-8", "replace").rstrip("\r\n").partition("\t")
                        if tab:
                            yield name, label, text

    return _members(binary(spark, path), members, "member string, label string, text string")


def tarred(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar archives (any compression); the folder is the class."""

    def members(_: str, content: bytes) -> Iterator[tuple]:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
            for m in t:
                f = t.extractfile(m) if m.isfile() else None
                if f is not None:
                    parts = m.name.split("/")
                    yield m.name, parts[-2] if len(parts) > 1 else "", f.read()

    return _members(binary(spark, path), members, "member string, folder string, content binary")


class _Text(html.parser.HTMLParser):
    """Text of an HTML body: no style, script or head; a new line at block ends."""

    BLOCKS = frozenset("p div br li tr table h1 h2 h3 h4 h5 h6 blockquote".split())
    HIDDEN = frozenset("style script head title".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN
        if tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(source: str) -> str:
    p = _Text()
    p.feed(source)
    return re.sub(r"[ \t]+", " ", re.sub(r"\n\s*\n+", "\n\n", "".join(p.out))).strip()


#: Charset names that mail programs use and Python does not know.
ALIASES = {"utf8": "utf-8", "iso-8859-8-i": "iso-8859-8", "x-unknown": "latin-1", "unknown-8bit": "latin-1", "default": "utf-8", "ansi": "cp1252", "_iso-2022-jp$esc": "iso-2022-jp"}


def decode(payload: bytes, charset: str | None) -> str:
    name = ALIASES.get((charset or "utf-8").lower(), charset or "utf-8")
    for way in (name, "utf-8", "latin-1"):
        try:
            return payload.decode(way)
        except (LookupError, UnicodeDecodeError):
            continue
    return payload.decode("utf-8", "replace")


def body(raw: bytes, prefer_plain: bool = True) -> tuple[str | None, str | None, str | None, str]:
    """(subject, from, date, text) of an RFC 2822 message. With ``prefer_plain`` the
    first plain part wins, else the HTML text; otherwise all text parts are joined."""
    try:
        m = email.message_from_bytes(raw, policy=email.policy.compat32)
    except Exception:  # noqa: BLE001 - a broken message is text
        return None, None, None, decode(raw, None)
    plain, rich = [], []
    for part in m.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        kind = part.get_content_type()
        payload = part.get_payload(decode=True)
        if payload is None or kind not in ("text/plain", "text/html"):
            continue
        text = decode(payload, part.get_content_charset())
        (plain if kind == "text/plain" else rich).append(text if kind == "text/plain" else html_text(text))
    text = ("\n".join(plain) if plain else "\n".join(rich)) if prefer_plain else " ".join(plain + rich)
    head = lambda n: str(m.get(n)) if m.get(n) is not None else None
    return head("subject"), head("from"), head("date"), text


def mbox_messages(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, raw): messages split at ``From `` lines by the text scan
    itself, so that a file of any size is read by many tasks. Positions grow in file
    order; the bytes are as stored."""
    # The delimiter takes the words "From " off all messages but the first of a file.
    r = spark.read.option("lineSep", "\nFrom ").text(path)
    return r.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("position"), F.col("value").cast("binary").alias("raw")).where(F.length("raw") > 0)


def mbox(spark: SparkSession, path: str, prefer_plain: bool = True) -> DataFrame:
    """Messages of mbox files: subject, from, date, text."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, i, raw in zip(pdf["file"], pdf["position"], pdf["raw"]):
                message = bytes(raw).partition(b"\n")[2]
                rows.append((f, i, *body(re.sub(rb"^>(>*From )", rb"\1", message, flags=re.M), prefer_plain)))
            yield pd.DataFrame(rows, columns=["file", "position", "subject", "from_addr", "date_raw", "text"])

    return mbox_messages(spark, path).mapInPandas(go, "file string, position bigint, subject string, from_addr string, date_raw string, text string")


def mbox_by_regex(spark: SparkSession, path: str) -> DataFrame:
    """Messages split at ``From `` lines in the JVM; the body follows the first blank line."""
    raw = mbox_messages(spark, path).select(F.col("raw").cast("string").alias("message"))
    return raw.select(F.regexp_extract("message", r"(?s)\A.*?\n\n(.*)\z", 1).alias("text"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Questions with arrays of human and generated answers, one row an answer."""
    schema = "question string, human_answers array<string>, chatgpt_answers array<string>"
    raw = spark.read.schema(schema).json(path)
    return explode_answers(raw)


def explode_answers(raw: DataFrame) -> DataFrame:
    side = lambda c, role: raw.select("question", F.lit(role).alias("role"), F.posexplode(c).alias("ordinal", "text"))
    return side("human_answers", "human").unionByName(side("chatgpt_answers", "chatgpt")).where(F.trim("text") != "")


def embedded_csv(df: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """Rows of CSV text inside a column: a header line or positional columns."""
    schema = ", ".join(f"{c} string" for c in columns)
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "_l")).where(F.trim("_l") != "")
    rows = lines.select(key, "line_no", F.from_csv("_l", F.lit(schema)).alias("r")).select(key, "line_no", "r.*")
    header = F.lower(F.trim(columns[0])) == columns[0].lower()
    rows = rows.where(~F.coalesce(header, F.lit(False)))
    return rows.withColumn(columns[0], F.regexp_replace(columns[0], r"^[^0-9]*", ""))


def prompt_blocks(text: str, separator: str = r"^=+\s*$") -> list[str]:
    """Non-empty blocks of a prompt file between separator lines."""
    return [b.strip() for b in re.split(separator, text, flags=re.M) if b.strip()]


def first_that_works(ways: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read (a row is asked for); the last error if none can."""
    last: Exception | None = None
    for way in ways:
        try:
            df = way()
            df.limit(1).collect()
            return df
        except Exception as e:  # noqa: BLE001 - try the next mirror
            last = e
    raise last or FileNotFoundError("no source given")


def prompt_files(spark: SparkSession, path: str, separator: str = r"(?m)^=+\s*$") -> DataFrame:
    """(file, block): non-empty blocks of prompt files between separator lines."""
    r = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode(F.split("value", separator)).alias("block"))
    return r.withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", "")).where("block != ''")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def pending_scores(rows: DataFrame, cache: DataFrame, key: str, needed: list[str]) -> DataFrame:
    """Rows whose cached values are missing or incomplete."""
    have = cache.dropna(subset=needed).select(key).distinct()
    return rows.join(have, key, "left_anti")


def complete(source: str, mirror: Callable[[str], Iterator[str]], jobs: DataFrame, schema: str) -> DataFrame:
    """Completions of a job grid by an external connector, one batch at a time."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[next(mirror(p)) for p in pdf[source]])

    return jobs.mapInPandas(go, schema)


