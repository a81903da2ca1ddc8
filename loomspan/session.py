"""Sessions, and tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


SMALL = 32 << 20  #: bytes a core of an input that spread deals out
ROW_GROUP = 4 << 20  #: bytes of a row group of durable's tables, about: tasks hold one when they write or read


def local_session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspan")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it lies in a few small files only, for work that takes far longer than reading.

    A file with one row group is one task, however long its rows take. With a quarter as many files as cores, or fewer, and
    no more than SMALL bytes a core in them, rows are dealt out evenly; larger inputs, and rows that lie in no files, stay as they are.
    """
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    few = 0 < 4 * len(files) <= cores
    return df.repartition(cores) if few and _size(spark, files) <= cores * SMALL else df


def _size(spark: SparkSession, files: list[str]) -> int:
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's spark.checkpoint.dir.

    A session on one machine (master local) that names none gets a temporary folder, set in it. On a cluster that is an
    error, as each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str = "files") -> str:
    """A new path in the shared folder, for files that durable does not write."""
    return f"{shared_folder(spark)}/{_own(spark)}/{uuid.uuid4().hex}/{name}"


def durable(df: DataFrame, name: str = "table", codec: str | None = None, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and return it as read from there.

    The rows survive lost executors, and what follows starts from files instead of a long lineage. Row groups are small,
    as a task holds one of them, and the reader's batches end with them, however long the texts are. by: a column whose
    values have files of their own, so that tasks are made of few long rows each. discard deletes the table; tables of
    returned, lazy results stay until clear.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    write = df.write.option("parquet.block.size", ROW_GROUP)
    write = write.partitionBy(by) if by else write
    (write.option("compression", codec) if codec else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"loomspan/{spark.sparkContext.applicationId}"


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The files and folders that a pattern names, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return [f.getPath().toString() for f in found or []]


def exists(spark: SparkSession, path: str) -> bool:
    return bool(listed(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that durable returned, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        own = f"/{_own(spark)}/"
        for folder in {f[: f.index(own)] + own + f[f.index(own) + len(own) :].split("/")[0] for f in table.inputFiles() if own in f}:
            _delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Delete all tables that durable wrote in this application, when its results are no longer needed."""
    _delete(spark, f"{shared_folder(spark)}/{_own(spark)}")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While jobs run in this block, Arrow batches hold so many rows at most, so tasks in Python need little memory.

    For tables of long texts. The session's setting is put back at the end; plans that run later have their batches
    bounded by spark.sql.execution.arrow.maxBytesPerBatch.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
