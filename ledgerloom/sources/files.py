"""Listing source files and reading them into blocks with source positions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import list_files, opened, reached
from .store import small_batches

#: Kinds of files that are input.
EXTENSIONS = ("docx", "doc", "pdf", "png", "jpg", "jpeg", "tif", "tiff")
_HELD = 4 << 20  # bytes of blocks that are passed on at once, about
BLOCKS = "file_id string, block_no int, kind string, page int, para int, row int, col int, text string, status string"


def accept_paths(df: DataFrame, path: str = "path", exts: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose path has one of the extensions and lies in none of the excluded folders."""
    out = df.where(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*exts))
    for folder in exclude:
        out = out.where(~F.col(path).startswith(folder.rstrip("/") + "/"))
    return out


def _listed_as(spark: SparkSession, path: str) -> str:
    """A path as Spark's listing writes it (file:/a for /a or file:///a)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _empty_ones(files: DataFrame) -> DataFrame:
    """(path, modified_at, n_bytes, content) of the files that Spark's listing has and its reader leaves
    out, as they hold no byte; the time is unknown."""
    listed = [(re.sub("^file:///", "file:/", unquote(x)),) for x in files.inputFiles()]
    rows = files.sparkSession.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    return rows.select("path", F.lit(None).cast("timestamp").alias("modified_at"), F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("content"))


def _with_content(files: DataFrame) -> DataFrame:
    """files (path, modified_at, n_bytes) with what is in each, read by tasks file after file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, size, since = [], 0, 0
            for i, path in enumerate(b["path"]):
                with opened(path) as (f, _):
                    held.append(f.read())
                size += len(held[-1])
                if i + 1 == len(b) or size > _HELD:
                    yield b.iloc[since : i + 1].assign(content=held, n_bytes=[len(x) for x in held])
                    held, size, since = [], 0, i + 1

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = files.dropDuplicates(["path"]).select("path", "modified_at", "n_bytes").repartition(n, "path")
    # a local path as Spark's listing writes it
    return rows.mapInPandas(read, "path string, modified_at timestamp, n_bytes long, content binary").withColumn("path", F.regexp_replace("path", "^file:///", "file:/"))


def list_sources(spark: SparkSession, roots: list[str], exts: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, modified_at, n_bytes, content) of all input files under roots, without those in the
    excluded folders, which may be written as roots may: with a scheme or without.

    Folders are listed and files read by tasks, and the driver knows of none, where pyarrow knows the
    store. Spark's own listing, which the driver holds, takes other stores and roots with patterns."""
    whole = [_listed_as(spark, x) for x in roots]
    if all(reached(x) for x in whole):
        return _with_content(list_files(spark, whole, exts, tuple(_listed_as(spark, x) for x in exclude)))
    # by the listing, so that no other file is opened
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in exts) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(roots)
    columns = ["path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("n_bytes"), "content"]
    files = files.select(*columns).unionByName(_empty_ones(files))
    return accept_paths(files, exts=exts, exclude=tuple(_listed_as(spark, x) for x in exclude))


def text_blocks(df: DataFrame, file: str, text: str = "text") -> DataFrame:
    """(file_id, block_no, kind, para, text): the lines of each text in order."""
    lines = df.select(F.col(file).alias("file_id"), F.posexplode(F.split(text, "\n")).alias("block_no", "text"))
    return lines.select("file_id", "block_no", F.lit("para").alias("kind"), (F.col("block_no") + 1).alias("para"), "text")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> Iterator[tuple[str, int | None, int | None, int | None, str]]:
    """(kind, para, row, col, text) of a Word file: headers and footers, then paragraphs and
    table cells in the order of the body, then the names of the images in it."""

    def words(node) -> str:
        return "".join(t.text or "" for t in node.iter(_W + "t"))

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            for kind in ("header", "footer"):
                if name.startswith(f"word/{kind}"):
                    yield kind, None, None, None, words(ElementTree.fromstring(z.read(name)))
        para = 0
        for node in ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body"):
            if node.tag == _W + "p":
                para += 1
                yield "para", para, None, None, words(node)
            elif node.tag == _W + "tbl":
                # a table within a cell is part of that cell's text
                for r, row in enumerate(node.findall(_W + "tr"), 1):
                    for c, cell in enumerate(row.findall(_W + "tc"), 1):
                        yield "cell", None, r, c, words(cell)
        for name in sorted(z.namelist()):
            if name.startswith("word/media/"):
                yield "picture", None, None, None, name


def block_reader(readers: dict[str, Callable[[bytes], Iterator[tuple]]] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over (file_id, path, content). readers: by extension; .docx is built in,
    readers of PDF and images are plugged in: they give (kind, para, row, col, text), or with a
    page (kind, page, para, row, col, text). A file that can't be opened, or has no reader,
    gives one row with its cause as status. Files are held whole; sources.blocks reads them by parts."""
    own = {"docx": docx_blocks} | (readers or {})
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("block_no", "page", "para", "row", "col")})

    def blocks(file_id: str, path: str, content: bytes) -> Iterator[tuple]:
        i = 0
        try:
            ext = path.rsplit(".", 1)[-1].lower()
            if ext not in own:
                raise ValueError(f"no reader for .{ext}")
            for x in own[ext](content):
                yield (file_id, i, *(x if len(x) == 6 else (x[0], None, *x[1:])), "read")
                i += 1
        except Exception as e:  # the cause goes to the review table
            yield (file_id, None, None, None, None, None, None, None, f"failed: {type(e).__name__}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for file_id, path, content in zip(batch.file_id, batch.path, batch.content, strict=True):
                rows = list(blocks(file_id, path, content))
                # of a file that breaks off only its cause is told
                for row in rows[-1:] if rows and rows[-1][1] is None else rows:
                    out.append(row)
                    held += 200 + len(row[7] or "")
                    if held > _HELD:
                        yield frame(out)
                        out, held = [], 0
            yield frame(out)

    return read


def read_blocks(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """Blocks of files (file_id, path, content). Lowers the session's bound on an Arrow batch to 4 MB
    where it is higher, so that a task holds few files at once."""
    small_batches(files.sparkSession)
    return files.select("file_id", "path", "content").mapInPandas(block_reader(readers), BLOCKS)
