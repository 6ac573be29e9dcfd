"""Intermediate tables on shared storage.

A staged table is computed once, read by any number of later queries and does
not depend on the executors that wrote it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own; on a cluster
    a missing setting is an error, because a machine's own disk is not shared.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="basketrank-")
        context.setCheckpointDir(_LOCAL_FOLDERS[app])
    return _LOCAL_FOLDERS[app]


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/basketrank/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_run_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Input of one task where rows multiply behind a shuffle: a few hundred thousand purchase lines.
BYTES_PER_PART = 6 * 1024 * 1024


def parts_for(df: DataFrame) -> int:
    """Partitions that grow with the files ``df`` reads, and at least those of other shuffles.

    For an explicit ``repartition``: adaptive execution merges all other partitions by
    the size of what was shuffled, which says little where rows multiply afterwards.
    """
    spark = df.sparkSession
    size = 0
    for file in df.inputFiles():
        store, place = _hadoop(spark, spark.sparkContext._jvm.java.net.URI(file))
        size += store.getFileStatus(place).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_PER_PART))


def read_batches(files: list[str], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Read Parquet files inside a task, at most ``rows`` rows at a time.

    ``files`` are the addresses that ``DataFrame.inputFiles`` gives for a staged
    table. ``pyarrow.fs`` knows local, HDFS and object stores.
    """
    for uri in files:
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as handle:
            yield from pq.ParquetFile(handle).iter_batches(batch_size=rows, columns=columns)


def _hadoop(spark: SparkSession, path: str):
    """The file system that ``path`` lies on, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing happens when there is none."""
    store, place = _hadoop(spark, path)
    store.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none when it does not exist."""
    store, place = _hadoop(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in the place of another one."""
    store, place = _hadoop(spark, source)
    _, goal = _hadoop(spark, target)
    store.delete(goal, True)
    store.mkdirs(goal.getParent())
    if not store.rename(place, goal):
        raise OSError(f"{source} could not be moved to {target}")


def release(spark: SparkSession) -> None:
    """Delete what this application staged; call it once its results are written."""
    remove(spark, _run_folder(spark))
