"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "corpusloom") -> SparkSession:
    """A local session for tests and benchmarks (a cluster brings its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make a temporary one only when
    neither the session nor the context has any and the session runs on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives
    the loss of executors, and is columnar and compressed. The folder is removed
    when the program ends, or by :func:`discard`; the shuffle files of the write, which
    nothing reads again, as soon as it is done."""
    path = remove_at_exit(df.sparkSession, shared_folder(df.sparkSession, "cut"))
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[id(out)] = path
    return out


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when the query ends, not when the driver
    happens to collect its garbage."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folder of each written table, by the identity of its frame.
_folders: dict[int, str] = {}


def discard(df: DataFrame) -> None:
    """Remove a table written by :func:`cut` that no later plan reads."""
    path = _folders.pop(id(df), None)
    if path is not None:
        _remove(df.sparkSession, path)


def remove_at_exit(spark: SparkSession, path: str) -> str:
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete through the file system the path belongs to, local or shared."""
    try:
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder goes with its parent
        pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the folder all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input with splits for at most half of them; an
    input with more is left alone, as evening it out is not worth a shuffle."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if 2 * df.rdd.getNumPartitions() <= want else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
