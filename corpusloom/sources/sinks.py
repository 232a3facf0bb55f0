"""Writers: line JSON, CSV, Parquet, per-split files, manifests, reports."""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns, also inside arrays, as null."""

    def bad(x: Column) -> Column:
        return F.isnan(x) | (x == float("inf")) | (x == float("-inf"))

    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~bad(c), c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: F.when(~bad(x), x))
        out.append(c.alias(f.name))
    return df.select(*out)


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Line JSON; nulls are written, not left out."""
    finite(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, key: str, schema: T.StructType) -> None:
    """Append the rows whose key is not there yet (resume)."""
    spark = df.sparkSession
    try:
        there = spark.read.schema(schema).json(path).select(key).distinct()
        df = df.join(there, key, "left_anti")
    except Exception as e:  # noqa: BLE001 - a first run has nothing to read
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, optionally one folder per value (split, evaluation slice)."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def csv_table(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def archives(df: DataFrame, folder: str, kind: str) -> int:
    """One ``zip`` or ``tar.gz`` a partition with the rows (member, content) of ``df``,
    in a folder that all executors mount; written aside and renamed, so a task that
    runs again leaves one archive. Returns the number of members."""
    place = folder.removeprefix("file:")
    place = "/" + place.lstrip("/")
    os.makedirs(place, exist_ok=True)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        path = f"{place}/part-{context.partitionId():05d}.{kind}"
        aside, n = f"{place}/.{context.taskAttemptId()}.{kind}", 0
        with zipfile.ZipFile(aside, "w", zipfile.ZIP_DEFLATED) if kind == "zip" else tarfile.open(aside, "w:gz") as out:
            for pdf in batches:
                for member, content in zip(pdf["member"], pdf["content"]):
                    data = content.encode()
                    if kind == "zip":
                        out.writestr(member, data)
                    else:
                        info = tarfile.TarInfo(member)
                        info.size = len(data)
                        out.addfile(info, io.BytesIO(data))
                    n += 1
        os.replace(aside, path)
        yield pd.DataFrame({"n": [n]})

    return df.select("member", "content").mapInPandas(go, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def markdown(df: DataFrame) -> str:
    """A result table as Markdown, fetched part by part (a report)."""
    rows = df.toLocalIterator()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def replace_block(document: str, name: str, block: str) -> str:
    """The document with the text between the markers of ``name`` replaced, or the
    block added at the end; doing it twice changes nothing."""
    a, b = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    body = f"{a}\n{block}\n{b}"
    found = re.compile(re.escape(a) + r".*?" + re.escape(b), re.S)
    return found.sub(lambda _: body, document) if found.search(document) else f"{document.rstrip()}\n\n{body}\n"


def merge_manifest(old: dict, new: dict, checks: list[dict], prefix: str) -> str:
    """Manifest JSON: new keys win, earlier checks under ``prefix`` are replaced."""
    kept = [c for c in old.get("checks", []) if not str(c.get("name", "")).startswith(prefix)]
    return json.dumps(old | new | {"checks": kept + checks}, indent=2, sort_keys=True, ensure_ascii=False)
