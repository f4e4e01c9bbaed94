"""Tables in the folder that all executors share, and models sent to executors after a check of their size."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a model table that is gathered and sent to executors: at most some 500 MB in each Python worker.
MODEL_ROWS = 3_000_000
#: Most rows of words, or of pairs of words, that are gathered and broadcast: some 30 MB in the driver.  More are joined, with the same results.
BROADCAST_ROWS = 200_000


class ModelTooLarge(ValueError):
    """A model table has more rows than may be sent to every executor."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"lexspark-{os.getuid()}")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexspark/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """What is written at ``path`` goes when the driver ends."""
    files, at = _filesystem(spark, path)
    files.deleteOnExit(at)


#: Where the tables lie that :func:`materialize` wrote.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and survives lost executors.

    The files go with :func:`discard`, or when the driver ends.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    forget(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path is not None:
            files, at = _filesystem(df.sparkSession, path)
            files.delete(at, True)


def gather(df: DataFrame, most: int = MODEL_ROWS) -> list[tuple]:
    """The rows of a model table on the driver; one of more than ``most`` rows is an error, never cut.

    They come as Arrow columns, so that a table that turns out too large takes little.
    """
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ModelTooLarge(f"more than {most} model rows")
    return list(zip(*[c.to_pylist() for c in rows.columns]))


def few(df: DataFrame) -> DataFrame:
    """``df``, marked to be broadcast in joins where a count shows that it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ship(spark: SparkSession, model: object):
    """Broadcast a model once; the result, called in a task, gives it.  Executors need no copy of the library."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: cloudpickle.loads(shared.value)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer partitions, as a table of one small file does; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
