"""Token ids of whole texts, and their flat binary form (operator 4).

Encoding: a text is cut where its tokenizer's own pre-tokenizer always cuts (at ASCII white
space), each distinct piece is encoded once by the tokenizers library and the ids are put
together by array look-ups. The ids equal those of encoding the whole text with
add_special_tokens=False, in which the string of a special token is that token. A text that holds
such a string or other Unicode white space is encoded whole, and so is every text where the
tokenizer's rules are others than those that the cuts rely on.

Format: tokens-NNNNN.bin holds the ids of one range of documents, flat, little-endian,
unsigned, of the narrowest fitting width; offsets-NNNNN.bin holds for each of its documents
the number of ids of all documents before it (64-bit unsigned; one more than documents);
docs-NNNNN.bin holds their ids (64-bit signed; a null id is the smallest such number).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import array_file, fresh_dir, read_array, small_batches, write_array
from .textcore import _WHITE, buffer_of, give_back, join_texts, pieces, ranges, segment_hash

_MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
NULL_ID = np.iinfo(np.int64).min
_KEEP_IDS = 6_000_000  # ids kept in one task for pieces met before
_STAY_IDS = 1_000_000  # ids kept between tasks
FILE_BYTES = 128 << 20
SLICE = 2 << 20  # bytes of text encoded at once: what is known is sorted anew after each slice

_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}
#: Kinds of normaliser and pre-tokenizer, by whether white space is kept.
_RULES = {
    False: (["NFC", "Replace \\s+", "Lowercase"], ["Split Removed 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "ByteLevel False False"]),
    True: ([], ["ByteLevel False True"]),
}


def _rules(part: dict | None) -> list[str]:
    """A tokenizer's steps of one kind, in words."""
    steps = [] if part is None else part.get("normalizers") or part.get("pretokenizers") or [part]
    more = lambda x: [x.get("behavior"), (x.get("pattern") or {}).get("Regex"), x.get("add_prefix_space"), x.get("use_regex")]
    return [" ".join(str(y) for y in (x["type"], *more(x)) if y is not None) for x in steps]


def encoder(path: str, keeps_space: bool) -> "Encoder":
    """One encoder a process for each tokenizer file."""
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = Encoder(path, keeps_space)
    return _ENCODERS[path, keeps_space]


class Encoder:
    """keeps_space: white space has tokens of its own, a space belongs to the word after it
    (byte-level tokenizers); else white space is dropped."""

    def __init__(self, path: str, keeps_space: bool) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.known_rules = (_rules(rules["normalizer"]), _rules(rules["pre_tokenizer"])) == _RULES[keeps_space]
        added = [re.escape(x.content.encode()) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(added), re.IGNORECASE) if added else None
        self.model = self.tokenizer.model
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keeps_space = keeps_space
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.width)

    def trim(self) -> None:
        """After a task: a worker stays, idle, beside stages of other kinds."""
        if len(self.ids) > _STAY_IDS:
            self._forget()
        give_back()

    def _fresh(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of each.

        A piece of ASCII letters (a space before it, a mark after it) is one word, or a word
        and a mark, to the pre-tokenizer, so the model takes these as they are; other pieces
        go through the whole tokenizer.
        """
        rows: list[list[int]] = [[]] * len(found)
        take, other = self.model.tokenize, []
        for i, x in enumerate(found):
            if not self.known_rules:
                other.append(i)
                continue
            if self.keeps_space:
                head, word = ("\u0120", x[1:]) if x[:1] == b" " else ("", x)
            else:
                head, word = "", x.lower()
            mark = word[-1:]
            if mark in _MARKS:
                word = word[:-1]
            if word.isalpha():
                rows[i] = [t.id for t in take(head + word.decode())]
                if mark in _MARKS:
                    rows[i] += [t.id for t in take(mark.decode())]
                continue
            other.append(i)
        for i, x in zip(other, self.tokenizer.encode_batch_fast([found[i].decode() for i in other], add_special_tokens=False), strict=True):
            rows[i] = x.ids
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), self.width, int(size.sum())), size

    def _cuts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece; no piece goes over a text's border."""
        white = _WHITE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        before = np.empty(len(buf), bool)
        before[:1] = False
        before[1:] = white[:-1]
        if not self.keeps_space:
            head = ~white & (before | edge[:-1])
            tail = np.empty(len(buf), bool)
            tail[:-1] = white[1:]
            tail[-1:] = True
            tail |= edge[1:]
            return np.flatnonzero(head), np.flatnonzero(tail & ~white) + 1
        after = np.ones(len(buf), bool)
        after[:-1] = white[1:]
        after |= edge[1:]
        head = edge[:-1] | (white & (~before | ~after))
        late = ~white & before & ~edge[:-1]
        late[1:] &= buf[:-1] != 0x20
        head |= late
        start = np.flatnonzero(head)
        return start, np.append(start[1:], len(buf)) if len(start) else start

    def _whole(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts (not empty ones) that are encoded whole."""
        if not self.known_rules:
            return np.flatnonzero(np.diff(off))
        odd = odd_space(buf, off)
        if self.added:
            at = [m.start() for m in self.added.finditer(buf.tobytes())]
            odd += (np.searchsorted(off, at, "right") - 1).tolist()
        return np.unique(np.array(odd, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each text."""
        buf, off = buffer_of(texts)
        start, end = self._cuts(buf, off)
        odd = self._whole(buf, off)
        if len(odd):
            first = np.searchsorted(start, off)
            whole = np.zeros(len(start), bool)
            for i in odd:
                whole[first[i] : first[i + 1]] = True
            start = np.sort(np.concatenate((start[~whole], off[:-1][odd])))
            end = np.sort(np.concatenate((end[~whole], off[1:][odd])))
        key = segment_hash(buf, start, end)
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        place[place == len(self.known)] = 0
        new = self.known[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            fresh = where[new]
            ids, size = self._fresh(join_texts(buf, start[fresh], end[fresh]))
            if len(self.ids) + len(ids) > _KEEP_IDS and len(self.known):
                # begin anew with this batch's pieces
                held = ~new
                kept = ranges(self.at[place[held]], self.size[place[held]])
                had, sizes = self.ids[kept], self.size[place[held]]
                self.known, self.size, self.ids = distinct[held], sizes, had
                self.at = np.cumsum(sizes) - sizes
            at = len(self.ids) + np.cumsum(size) - size
            order = np.argsort(known := np.concatenate((self.known, distinct[new])))
            self.known = known[order]
            self.at, self.size = np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]
            self.ids = np.concatenate((self.ids, ids))
            place = np.searchsorted(self.known, distinct)
        at, size = self.at[place][back], self.size[place][back]
        ids = self.ids[ranges(at, size)]
        run = np.concatenate(([0], np.cumsum(size)))
        if len(self.ids) > 2 * _KEEP_IDS:
            self._forget()
        return ids, np.diff(run[np.searchsorted(start, off)])


def odd_space(buf: np.ndarray, off: np.ndarray) -> list[int]:
    """Texts with Unicode white space that is not ASCII."""
    high = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
    high = high[high < len(buf) - 1]
    if not len(high):
        return []
    a, b = buf[high], buf[high + 1]
    c = buf[np.minimum(high + 2, len(buf) - 1)]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(off, high[hit], "right") - 1).tolist()


def with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by end_id."""
    return np.insert(ids, np.cumsum(count), end_id), count + 1


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _file(folder: str, kind: str, part: int) -> str:
    return f"{folder}/{kind}-{part:05d}.bin"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, n_files: int | None = None) -> int:
    """Writes docs (doc_id, text, more columns are left out) in ascending doc_id order; the
    number of all ids. Null texts count as empty, and give the end id alone; a null doc_id
    comes first; rows of one doc_id are ordered by a hash of the text, then by text. An empty
    table makes no ids. A text is encoded whole, however long.

    Documents are range-partitioned by doc_id and that hash, a file each, of FILE_BYTES of text
    in the mean at most; ids are written as they are made. The driver sees two numbers a file:
    their prefix sums are the bases of the offsets. A task that runs again writes the same file
    again under its own temporary name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    if n_files is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code = TaskContext.get().partitionId(), encoder(tokenizer, False)
        with ExitStack() as files:
            out, n_docs, n_tokens = {}, 0, 0
            for b in pieces(batches, n_bytes=SLICE):
                if not out:
                    out = {kind: files.enter_context(array_file(_file(folder, kind, part))) for kind in ("tokens", "docs", "local")}
                    out["local"](np.zeros(1, "<u8"))
                found, count = with_end(*code.encode(b.column("text")), end_id)
                out["tokens"](found.astype(code.width))
                out["docs"](b.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                out["local"]((n_tokens + np.cumsum(count)).astype("<u8"))
                n_docs, n_tokens = n_docs + len(count), n_tokens + len(found)
        code.trim()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ranged = rows.repartitionByRange(n_files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    totals = sorted(ranged.mapInArrow(write, "part long, n_docs long, n_tokens long").collect())
    bases = np.concatenate(([0], np.cumsum([r.n_tokens for r in totals], dtype=np.int64)))
    if not totals:
        return 0

    def rebase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(*b.to_pydict().values(), strict=True):
                write_array(_file(folder, "offsets", part), read_array(_file(folder, "local", part), "<u8") + np.uint64(base))
            yield b

    table = spark.createDataFrame([(r.part, int(base)) for r, base in zip(totals, bases, strict=False)], "part long, base long")
    table.repartition(len(totals), "part").mapInArrow(rebase, "part long, base long").write.parquet(f"{folder}/parts")
    return int(bases[-1])


def read_token_files(spark: SparkSession, folder: str, width: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; tokens and
    offsets are memory-mapped."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("part").to_pylist():
                tokens = read_array(_file(folder, "tokens", part), width)
                at = read_array(_file(folder, "offsets", part), "<u8").astype(np.int64)
                ids = read_array(_file(folder, "docs", part), "<i8")
                for lo in range(0, len(ids), 5000):
                    hi = min(lo + 5000, len(ids))
                    own = at[lo : hi + 1]
                    crc = [crc32(tokens[x - at[0] : y - at[0]]) for x, y in zip(own[:-1], own[1:], strict=True)]
                    some = np.asarray(ids[lo:hi])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(some, mask=some == NULL_ID), "start": pa.array(own[:-1]),
                        "n_tokens": pa.array(np.diff(own)), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    parts = spark.read.schema("part long, base long").parquet(f"{folder}/parts")
    return parts.select("part").repartition("part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int, n_files: int | None = None) -> DataFrame:
    """Writes the token files to a new shared folder and reads them back."""
    spark, folder = docs.sparkSession, fresh_dir(docs.sparkSession, "tokens")
    if not write_token_files(docs, folder, tokenizer, end_id, n_files):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, encoder(tokenizer, False).width.str)
