"""Source files as a table of blocks, read part by part.

`block_source` makes a data source for spark.read: it lists the files under a path, opens none, and
deals them out by size; a file's parts are planned by the tasks that read them. `document_blocks`
does the same for a table of paths, planning is then a job of its own. `list_files` lists in
tasks, for more files than one process should know of.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import astuple
from functools import reduce
from typing import Any, BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import READERS, Reader
from .store import written

BLOCK = (
    "file_id string, part int, block_no int, kind string, page int, para int, row int, col int, text string, name string, "
    "width int, height int, content binary, status string"
)
_NO_BLOCK = (None,) * 10
_OPENING = 64 << 10  # bytes that opening a file counts as


def _local(path: str) -> str | None:
    """The path of a file of this machine, however it is written; None for any other store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _store(path: str):
    """(file system, path in it); a local path may hold any characters."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), local) if (local := _local(path)) is not None else fs.FileSystem.from_uri(path)


def reached(path: str) -> bool:
    """Whether pyarrow knows the path's store; patterns, which Spark's own sources take, it doesn't."""
    try:
        _store(path)
    except (ValueError, NotImplementedError, OSError):
        return False
    return not any(c in path for c in "*?[{\\")


def _named(path: str) -> str:
    return path if (local := _local(path)) is None else "file://" + local


@contextmanager
def opened(path: str) -> Iterator[tuple[BinaryIO, int]]:
    """A seekable file of any store that pyarrow knows, and its size; read in pieces, on demand."""
    if (local := _local(path)) is not None:
        with open(local, "rb") as f:
            yield f, os.path.getsize(local)
        return
    store, at = _store(path)
    with store.open_input_file(at) as f:
        yield f, f.size()


@contextmanager
def new_file(path: str) -> Iterator[BinaryIO]:
    """A file of such a store, written from the start; folders above it are made. A local file takes its
    place once it is whole, as an object store's does, whatever becomes of its task or of a second one."""
    store, at = _store(path)
    folder = at.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    temp = f"{folder}/.{uuid.uuid4().hex}.tmp" if _local(path) is not None else at
    with store.open_output_stream(temp) as f:
        yield f
    if temp != at:
        store.move(temp, at)


def _reader(path: str, readers: dict[str, Reader]) -> Reader:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in readers:
        raise ValueError(f"no reader for .{ext}")
    return readers[ext]


def plan_file(path: str, readers: dict[str, Reader]) -> list[tuple[int, Any, str | None]]:
    """(part number, part, failure) of a file; one that can't be opened has one part, its failure."""
    try:
        reader = _reader(path, readers)
        with opened(path) as (f, size):
            return [(i, part, None) for i, part in enumerate(reader.parts(f, size))]
    except Exception as e:  # the cause goes to the review table
        return [(0, None, f"failed: {type(e).__name__}: {e}")]


def part_rows(path: str, number: int, part: Any, failure: str | None, readers: dict[str, Reader]) -> Iterator[tuple]:
    """Rows of a part, by BLOCK; where it breaks off, a last one with the cause."""
    n = 0
    if failure is None:
        try:
            with opened(path) as (f, _):
                for block in _reader(path, readers).read(f, part):
                    yield (path, number, n, *astuple(block), "read")
                    n += 1
            return
        except Exception as e:
            failure = f"failed: {type(e).__name__}: {e}"
    yield (path, number, n, *_NO_BLOCK, failure)


def _share(path: str, k: int, n: int, readers: dict[str, Reader]) -> Iterator[tuple]:
    """Rows of each n-th part of a file, from the k-th on; the file's parts are planned where they are read."""
    for number, part, failure in plan_file(path, readers):
        if number % n == k:
            yield from part_rows(path, number, part, failure, readers)


def _entries(folder: str) -> tuple[list[str], list[tuple[str, int, int | None]]]:
    """Folders in a folder, and (path, size, time of its last change in ms) of the files in it; a file has itself."""
    from pyarrow import fs

    store, root = _store(folder)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
    # what stands before a path in its store: the scheme, and the host where the store leaves it out
    before = _named(folder).removesuffix("/").removesuffix(root.removesuffix("/"))
    return [before + x.path for x in found if x.type == fs.FileType.Directory], [
        (before + x.path, x.size or 0, None if x.mtime_ns is None else x.mtime_ns // 10**6) for x in found if x.type == fs.FileType.File
    ]


def _read_as(path: str, exts) -> bool:
    return path.rsplit(".", 1)[-1].lower() in exts


class _Shares(InputPartition):
    def __init__(self, items: list[tuple[str, str, int, int]]):
        self.items = items


class _BlockReader(DataSourceReader):
    def __init__(self, options, readers: dict[str, Reader]):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        self.exclude = tuple(_named(x).rstrip("/") + "/" for x in (options.get("exclude") or "").split(",") if x)
        self.at_once, self.most = int(options.get("planners", "16")), int(options.get("partsPerPartition", "1000"))
        self.size = int(options.get("bytesPerPartition", str(32 << 20)))
        self.readers = readers

    def partitions(self) -> list[_Shares]:
        out, held, items = [], 0, []
        folders = [self.path]
        with ThreadPoolExecutor(self.at_once) as pool:  # waiting for the store, mostly
            while folders:
                below = []
                for own, files in pool.map(_entries, folders):
                    below += own
                    for path, size, _ in sorted(files, key=lambda x: x[0]):
                        if not _read_as(path, self.readers) or path.startswith(self.exclude):
                            continue
                        folder, _, name = path.rpartition("/")
                        n = max(1, -(-size // self.size))
                        for k in range(n):
                            if items and (held >= self.size or len(items) >= self.most):
                                out.append(_Shares(items))
                                held, items = 0, []
                            if items and items[-1][0] == folder:
                                folder = items[-1][0]  # one text, which is written down once
                            items.append((folder, name, k, n))
                            held += size // n + _OPENING
                folders = [x for x in below if not (x + "/").startswith(self.exclude)]
        return [*out, _Shares(items)]

    def read(self, partition: _Shares) -> Iterator[tuple]:
        for folder, name, k, n in partition.items:
            yield from _share(f"{folder}/{name}", k, n, self.readers)


def block_source(readers: dict[str, Reader] | None = None, name: str = "document_blocks") -> type[DataSource]:
    """A data source of BLOCK rows, for spark.dataSource.register and spark.read.format(name).

    Options: path (a file or folder of any store that pyarrow knows), exclude (folders, by comma),
    bytesPerPartition (32 MB; a larger file is shared out among several, each of which takes every
    so many parts of it), partsPerPartition (1000: files or shares of files), planners (16: folders
    listed at once). Files are those with a reader's extension; readers are plugged in beside the
    built-in ones. (file_id, part, block_no) tells blocks apart and gives
    their order in the file. A file that can't be read, or a part that breaks off, gives a row with
    its cause as status."""
    own = READERS | (readers or {})

    class Blocks(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BLOCK

        def reader(self, schema) -> DataSourceReader:
            return _BlockReader(self.options, own)

    return Blocks


def list_files(spark: SparkSession, roots: list[str], exts: tuple[str, ...], exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, n_bytes, modified_at) of all files under roots (files or folders of any store that pyarrow knows)
    with one of the extensions, without those in excluded folders and, as in Spark's own listing,
    hidden ones. Folders are listed by tasks, level by level; the driver sees counts alone."""
    left_out = tuple(_named(x).rstrip("/") + "/" for x in exclude)

    def hidden(path: str) -> bool:
        name = path.rpartition("/")[2]
        return name.startswith(".") or (name.startswith("_") and "=" not in name)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["path"]:
                below, files = _entries(folder)
                found = [(x, None, None) for x in below if not hidden(x) and not (x + "/").startswith(left_out)]
                found += [x for x in files if not hidden(x[0]) and not x[0].startswith(left_out) and _read_as(x[0], exts)]
                for i in range(0, len(found), 10_000):
                    yield pd.DataFrame(found[i : i + 10_000], columns=["path", "n_bytes", "ms"]).astype({"n_bytes": "Int64", "ms": "Int64"})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, levels = spark.createDataFrame([(_named(x),) for x in roots], "path string"), []
    while not folders.isEmpty():
        levels.append(written(folders.repartition(n, "path").mapInPandas(entries, "path string, n_bytes long, ms long"), "listed"))
        folders = levels[-1].where("n_bytes IS NULL").select("path")
    none = spark.createDataFrame([], "path string, n_bytes long, ms long")
    found = reduce(DataFrame.unionByName, levels, none).where("n_bytes IS NOT NULL")
    return found.select("path", "n_bytes", F.timestamp_millis("ms").alias("modified_at"))


def document_blocks(files: DataFrame, readers: dict[str, Reader] | None = None, path: str = "path", tasks: int | None = None) -> DataFrame:
    """BLOCK rows of files (path): parts are planned by tasks, dealt out evenly, and read. A path
    that stands there twice is read once; a null path is left out."""
    own = READERS | (readers or {})

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, pickle.dumps(part), failure) for p in b["path"] for i, part, failure in plan_file(p, own)]
            yield pd.DataFrame(rows, columns=["path", "number", "part", "failure"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCK.split(", ")]
        whole = {c.split()[0]: "Int32" for c in BLOCK.split(", ") if c.endswith(" int")}

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype(whole)

        for b in batches:
            rows, held = [], 0
            for p, i, part, failure in zip(b["path"], b["number"], b["part"], b["failure"], strict=True):
                for row in part_rows(p, i, pickle.loads(part), failure, own):
                    rows.append(row)
                    held += 200 + len(row[8] or "") + len(row[12] or b"")
                    if held > 8 << 20:
                        yield frame(rows)
                        rows, held = [], 0
            yield frame(rows)

    planned = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct().mapInPandas(plan, "path string, number int, part binary, failure string")
    n = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return planned.repartition(n, "path", "number").mapInPandas(read, BLOCK)
