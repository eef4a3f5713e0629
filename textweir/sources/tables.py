"""Tables and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names. Where it is unset, a local session gets a new folder; others fail."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='textweir-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() makes inside are deleted at the end; what is made of them must be written by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            deleted(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: later stages depend on files, not on executors.

    The files stay for as long as a result may read them: until dropped(), the end of scratch(), or the folder is cleared."""
    path = shared_path(df.sparkSession, label)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if its files make fewer partitions than there are cores, as one small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _folder(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop's."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def deleted(spark: SparkSession, path: str) -> None:
    at, files = _folder(spark, path)
    files.delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table of stored() that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        deleted(df.sparkSession, file.rpartition("/")[0])


def batches(spark: SparkSession, path: str) -> list[int]:
    """The k of the finished folders batch=k under path, ascending."""
    at, files = _folder(spark, path)
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    found = (int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return sorted(k for k in found if files.exists(_folder(spark, f"{path}/batch={k}/_SUCCESS")[0]))
