"""Benchmark decontamination by winnowing (operator 8).

Of each 9 successive 5-word grams (13 words) of a document the smallest hash is kept. On the
benchmark's side all 5-word grams are kept, so any 13 words in common share a kept gram. Hits
are joined on that hash and extended word by word in both texts. Items shorter than the window
are matched as a whole.

The benchmark's side is laid down in the shared folder in blocks of bounded size and
memory-mapped; documents are scanned where they are and never shuffled.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_dir, read_array, write_array
from .textcore import Words, pieces, ranges, sliding, window_hash, words_of

BLOCK_BYTES = 16 << 20
HELD = 8  # blocks that a task holds open
PAIRS = 1 << 20  # places of grams in the benchmark that are followed at once


def winnowed(h: np.ndarray, same: np.ndarray, width: int) -> np.ndarray:
    """Which of the hashes is the smallest of some run of width successive ones; same[i]: the
    run that begins at i lies in one document."""
    if len(h) < width:
        return np.zeros(len(h), bool)
    least = sliding(h, width)
    least[~same[: len(least)]] = 0
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate((pad, least, pad)), width, np.maximum)
    return (most == h) & (most > 0)


def _index_block(words: Words, ids: list[str], n: int, k: int) -> dict[str, np.ndarray]:
    count = words.count()
    doc, at, h = words.windows(k)
    long = count[doc] >= n
    h, at = h[long], at[long]
    order = np.argsort(h, kind="stable")
    out = {"words": words.hash, "first": words.first.astype(np.int64), "fp": h[order], "fp_at": at[order]}
    for size in range(1, n):
        own = np.flatnonzero(count == size)
        if len(own):
            hs = window_hash(words.hash, size)[words.first[:-1][own]]
            order = np.argsort(hs, kind="stable")
            out[f"short{size}"], out[f"short{size}_item"] = hs[order], own[order].astype(np.int64)
    names = [x.encode() for x in ids]
    out["ids"], out["id_end"] = np.frombuffer(b"".join(names), np.uint8), np.cumsum([len(x) for x in names]).astype(np.int64)
    return out


class Index:
    """A block of the benchmark, read from the shared folder."""

    def __init__(self, uri: str, kinds: dict[str, str]) -> None:
        self.part = {k: read_array(f"{uri}/{k}.bin", kind) for k, kind in kinds.items()}
        self.short = sorted(int(k[5:]) for k in kinds if k.startswith("short") and not k.endswith("item"))

    def name(self, item: int) -> str:
        end = self.part["id_end"]
        return bytes(self.part["ids"][int(end[item - 1]) if item else 0 : int(end[item])]).decode()

    def pairs(self, keys: np.ndarray, name: str, to: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number in keys, what stands at the key) for each key that is found, so many at once
        that a gram of very many items takes no more memory than others."""
        lo = np.searchsorted(self.part[name], keys, "left")
        found = np.flatnonzero(lo < len(self.part[name]))
        found = found[self.part[name][lo[found]] == keys[found]]
        size = np.searchsorted(self.part[name], keys[found], "right") - lo[found]
        run = np.cumsum(size)
        for at in range(0, int(run[-1]) if len(run) else 0, PAIRS):
            first, last = np.searchsorted(run, [at, min(at + PAIRS, run[-1]) - 1], "right")
            own = np.arange(first, last + 1)
            begin = np.maximum(at - (run[own] - size[own]), 0)
            n = np.minimum(size[own], at + PAIRS - (run[own] - size[own])) - begin
            yield np.repeat(found[own], n), np.asarray(self.part[to])[ranges(lo[found[own]] + begin, n)]


def _hits(w: Words, index: Index, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, end word, item) of what the documents share with the block."""
    doc = w.doc()
    h = window_hash(w.hash, k)
    if len(h) and len(index.part["fp"]):
        width = n - k + 1
        same = np.zeros(len(h), bool)
        if len(doc) >= n:
            same[: len(doc) - n + 1] = doc[: len(doc) - n + 1] == doc[n - 1 :]
        at = np.flatnonzero(winnowed(h, same, width))
        bench, first = index.part["words"], np.asarray(index.part["first"])
        for i, q in index.pairs(h[at], "fp", "fp_at"):
            p = at[i]
            item = np.searchsorted(first, q, "right") - 1
            left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            whole = doc[p] == doc[np.minimum(p + k - 1, len(doc) - 1)]
            go_l, go_r = whole.copy(), whole.copy()
            for j in range(1, width):
                x, y = np.maximum(p - j, 0), np.maximum(q - j, 0)
                go_l &= (p - j >= w.first[:-1][doc[p]]) & (q - j >= first[item]) & (w.hash[x] == bench[y])
                left += go_l
                x, y = np.minimum(p + k - 1 + j, len(doc) - 1), np.minimum(q + k - 1 + j, len(bench) - 1)
                go_r &= (p + k - 1 + j < w.first[1:][doc[p]]) & (q + k - 1 + j < first[item + 1]) & (w.hash[x] == bench[y])
                right += go_r
            ok = whole & (left + right + k >= n)
            yield (p - left)[ok], (p + k + right)[ok], item[ok]
    for size in index.short:
        _, at, hs = w.windows(size)
        for i, item in index.pairs(hs, f"short{size}", f"short{size}_item"):
            yield at[i], at[i] + size, item


def _lists(values: pa.Array, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), values)


def index_benchmark(bench: DataFrame, n: int = 13, k: int = 5) -> tuple[str, list[dict]]:
    """Writes the index of bench (item_id, text) in blocks; the folder and what each block holds."""
    folder = fresh_dir(bench.sparkSession, "benchmark")
    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches), pa.schema([("item_id", pa.string()), ("text", pa.string())])).combine_chunks()
        if table.num_rows:
            words = words_of(table.column("text").combine_chunks(), "alnum")
            arrays = _index_block(words, [x or "" for x in table.column("item_id").to_pylist()], n, k)
            for name, x in arrays.items():
                write_array(f"{folder}/{part}/{name}.bin", x)
            kinds = json.dumps({name: x.dtype.str for name, x in arrays.items()})
            yield pa.RecordBatch.from_pydict({"part": [part], "kinds": [kinds]})

    blocks = rows.repartition(-(-total // BLOCK_BYTES) or 1).mapInArrow(write, "part long, kinds string").collect()
    return folder, [{"part": r.part, "kinds": json.loads(r.kinds)} for r in blocks]


SPANS = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"


def shared_spans(docs: DataFrame, bench: DataFrame, n: int = 13, k: int = 5) -> DataFrame:
    """docs (with a text column; all columns are kept) and n_words, spans (word ranges within
    any occurrence of a benchmark window, disjoint, from 0, end excluded) and items (ids of
    the items with such windows, as sorted strings). A null or empty text has no words. A
    null item_id counts as ''. An empty benchmark gives no spans, an empty table no rows;
    repeated rows are judged alike. Columns named n_words, spans or items are replaced.
    """
    folder, blocks = index_benchmark(bench, n, k)
    docs = docs.drop("n_words", "spans", "items")
    schema = docs.sparkSession.createDataFrame([], SPANS).schema
    held: OrderedDict[int, Index] = OrderedDict()

    def opened(block: dict) -> Index:
        if block["part"] not in held:
            held[block["part"]] = Index(f"{folder}/{block['part']}", block["kinds"])
            while len(held) > HELD:
                held.popitem(last=False)
        held.move_to_end(block["part"])
        return held[block["part"]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a benchmark of more blocks than stay open, each is opened once for more texts
        for b in pieces(batches, n_bytes=(1 << 20) * (1 if len(blocks) <= HELD else 4)):
            w = words_of(b.column("text"), "alnum")
            edge = np.zeros(len(w.hash) + 1, np.int64)
            named: set[tuple[int, str]] = set()
            doc = w.doc()
            for block in blocks:
                index = opened(block)
                for a, z, item in _hits(w, index, n, k):
                    np.add.at(edge, a, 1)
                    np.add.at(edge, z, -1)
                    if len(a):
                        named |= {(d, index.name(i)) for d, i in np.unique(np.stack((doc[a], item)), axis=1).T.tolist()}
            hit = np.cumsum(edge[:-1]) > 0
            prev = np.concatenate(([False], hit[:-1]))
            new = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
            begins = np.flatnonzero(hit & (~prev | new))
            ends = np.flatnonzero(hit & (np.append(~hit[1:], True) | np.append(new[1:], True))) + 1 if len(doc) else begins
            per = np.bincount(doc[begins], minlength=b.num_rows) if len(begins) else np.zeros(b.num_rows, np.int64)
            base = w.first[:-1][doc[begins]] if len(begins) else np.zeros(0, np.int64)
            spans = _lists(pa.StructArray.from_arrays([pa.array(begins - base, pa.int64()), pa.array(ends - base, pa.int64())], ["first", "end"]), per)
            named = sorted(named)
            items = _lists(pa.array([x for _, x in named], pa.string()), np.bincount([d for d, _ in named], minlength=b.num_rows) if named else np.zeros(b.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w.count(), pa.int64()), spans, items], [*b.schema.names, "n_words", "spans", "items"])

    return docs.mapInArrow(scan, type(schema)(docs.schema.fields + schema.fields))


def contamination(docs: DataFrame, bench: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """shared_spans with n_hit (words hit) and contaminated: share * n_hit >= n_words and some hit."""
    found = shared_spans(docs, bench, n)
    found = found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.first)"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
