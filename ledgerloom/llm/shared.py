"""The folder that driver and executors share, tables and files kept in it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where none is set and driver and executors are one
    process (tests) a temporary folder takes its place; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_WITHIN: list[str] = []  # folders of the steps now being built, the innermost last


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_WITHIN[-1] if _WITHIN else shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def folder_for(spark: SparkSession, name: str) -> Iterator[str]:
    """Paths made meanwhile lie in one new folder, which can be removed as a whole."""
    _WITHIN.append(fresh_dir(spark, name))
    try:
        yield _WITHIN[-1]
    finally:
        _WITHIN.pop()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that fresh_dir or folder_for made, by the store's own interface."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, n_bytes: int = 4 << 20) -> None:
    """Lowers the session's bound on an Arrow batch to n_bytes, where it is higher: by default
    a task passes the texts of its whole partition to Python as one batch, held several times."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864b").rstrip("b")) > n_bytes:
        spark.conf.set(key, str(n_bytes))


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: the lineage ends here."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that have been written down: it does so once the
    driver's JVM has collected the plans, which by itself may take as long as the whole job."""
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, name: str, most: int = 10_000) -> DataFrame:
    """df, written down, and marked for a broadcast if it has no more than so many rows: of a
    table with a few rows a language, say, whose number of languages isn't known beforehand."""
    df = settle(df, name)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def array_file(uri: str) -> Iterator[Callable[[np.ndarray], None]]:
    """Writes one array after another to a file; readers see the whole file or none."""
    task = TaskContext.get()
    temp = f"{uri}.{task.taskAttemptId() if task else 0}.tmp"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(temp), "wb") as f:
            yield lambda x: f.write(memoryview(np.ascontiguousarray(x)).cast("B") if x.size else b"")
        os.replace(_local(temp), path)
        return
    store, path = _store(temp)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        yield lambda x: f.write(np.ascontiguousarray(x).tobytes())
    store.move(path, _store(uri)[1])


def write_array(uri: str, x: np.ndarray) -> None:
    with array_file(uri) as write:
        write(x)


def read_array(uri: str, dtype) -> np.ndarray:
    """The file as an array; memory-mapped where the path is a local one."""
    if (path := _local(uri)) is not None:
        if not os.path.getsize(path):
            return np.zeros(0, dtype)
        return np.memmap(path, dtype, "r")
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
