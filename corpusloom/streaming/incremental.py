"""Incremental processing: file streams, first-seen records, event windows.

The corpus pipeline resumes by key; as a stream that is a file source whose
batches append only keys not seen before. Window counts over events show late
data handled by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int = 8) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)


def first_seen(stream: DataFrame, text: str, at: str, late: str = "7 days") -> DataFrame:
    """The first record of every text within the watermark's horizon."""
    return stream.withColumn("_k", F.md5(F.trim(F.coalesce(F.col(text), F.lit(""))))).withWatermark(at, late).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def append_new_keys(stream: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the first row of every key. Keys seen before are state beside the
    checkpoint, so a run that goes on from it reads only new files, and neither what
    was written nor the input is read again; the file sink writes each batch once."""
    new = stream.dropDuplicates([key])
    return new.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_windows(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Counts of windows that are still open as well: each batch that changes them
    writes the changed ones under its number; :func:`latest` reads the last of each."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, keys: list[str], value: str) -> DataFrame:
    r = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return r.groupBy(*keys).agg(F.max_by(value, "_batch").alias(value))


def tumbling(events: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per window and keys, closed once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, gap: str, late: str, *by: str) -> DataFrame:
    """Sessions: events of one key with no pause longer than ``gap``."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))
