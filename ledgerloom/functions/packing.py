"""Greedy packing of blocks in order, part by part.

A part knows what follows from each state that it may begin in: how much the open fragment holds
already decides where the first break falls, and from any break on all others follow. These few
rows a part are folded over the parts once; then each part packs its blocks by itself. Breaks are
found by pointers from each block to the one that the next fragment would begin with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "part int, first long, last long, whole boolean, at_least long, breaks long, used long, last_breaks long, last_used long"


def successors(n: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next, before, upto): the block that the fragment after one beginning at a block begins with
    (at most the end of its file), lengths before a block, and with it. A fragment that holds
    nothing yet takes any block."""
    upto = np.cumsum(n)
    before = upto - n
    nxt = np.maximum(np.searchsorted(before, before, "right"), np.searchsorted(upto, before + size, "right"))
    return np.minimum(nxt, ends), before, upto


def _files(fid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each file, end of each block's file)."""
    starts = np.flatnonzero(np.concatenate(([True], fid[1:] != fid[:-1])))
    return starts, np.repeat(np.append(starts[1:], len(fid)), np.diff(np.append(starts, len(fid))))


def _to_the_end(nxt: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragments, start of the last one) from each block before end on, by pointers twice as far each time."""
    count = np.append(np.ones(end, np.int64), 0)
    jump, last = np.append(nxt[:end], end), np.append(np.arange(end), end)
    while (jump[:end] < end).any():
        last = np.where(jump < end, last[jump], last)
        count = count + count[jump]
        jump = jump[jump]
    return count[:end], last[:end]


def summary(fid: np.ndarray, n: np.ndarray, size: int) -> list[tuple]:
    """Rows (first, last, whole, at_least, breaks, used, last_breaks, last_used) of a part: in its
    first file, a fragment that holds at_least or more (up to the next row's) when the part
    begins leads to so many breaks, and to an open fragment that holds used; at_least 0 is no more than 0, a
    row with -1 tells the length of the file's blocks, where there is no break. last_*: of its
    last file, if that is another, from its own start."""
    starts, ends = _files(fid)
    nxt, before, upto = successors(n, ends, size)
    end = int(ends[0])
    total = int(upto[end - 1])
    count, last = _to_the_end(nxt, end)
    tail = (None, None)
    if len(starts) > 1:
        a = int(starts[-1])
        c, x = _to_the_end(nxt[a:] - a, len(n) - a)
        tail = (int(c[0]) - 1, int(upto[-1] - before[a + x[0]]))
    shared = (int(fid[0]), int(fid[-1]), len(starts) == 1)
    out = [(*shared, -1, 0, total, *tail)]
    # the first break, from an open fragment that holds something: where its block makes it too long
    head = np.flatnonzero(np.concatenate(([True], n[1:end] > 0)) & (upto[:end] - n[:end] < size))
    for b in head.tolist():
        out.append((*shared, max(1, size - int(upto[b]) + 1), int(count[b]), total - int(before[last[b]]), *tail))
    # from an empty one: as from the file's start
    out.append((*shared, 0, int(count[0]) - 1, total - int(before[last[0]]), *tail))
    return out


def fold(rows: Iterator[tuple]) -> Iterator[tuple[int, int, int]]:
    """(part, used, fragment) with which each part begins; rows of PART by part."""
    file, used, frag = None, 0, 0
    part, table = None, []

    def step() -> tuple[int, int, int]:
        nonlocal file, used, frag
        first, last, whole, _, _, total, last_breaks, last_used = table[0][1:]
        if first != file:
            used, frag = 0, 0
        begun = (part, used, frag)
        rows_ = [r for r in table if r[4] >= 0 and (r[4] == 0) == (used == 0) and r[4] <= used]
        if rows_:
            row = max(rows_, key=lambda r: r[4])
            used, frag = row[6], frag + row[5]
        else:
            used += next(r[6] for r in table if r[4] == -1)
        file = first
        if not whole:
            file, used, frag = last, last_used, last_breaks
        return begun

    for r in rows:
        if r[0] != part and table:
            yield step()
            table = []
        part = r[0]
        table.append(r)
    if table:
        yield step()


def fragments(fid: np.ndarray, n: np.ndarray, size: int, used: int, frag: int) -> np.ndarray:
    """The fragment number of each block of a part that begins so."""
    starts, ends = _files(fid)
    nxt, before, upto = successors(n, ends, size)
    end = int(ends[0])
    if used:  # where the open fragment ends
        first = min(int(np.searchsorted(upto, size - used, "right")), end)
    else:
        first = 0
    brk = np.zeros(len(n) + 1, np.int64)
    at = np.append(starts[1:], np.array([first] if first < end else [], np.int64))
    while len(at):
        brk[at] = 1
        stop = ends[at]
        at = nxt[at]
        at = at[at < stop]
    run = np.cumsum(brk[:-1])
    # a file's own start is no break; the first file goes on from the open fragment
    base = np.repeat(run[starts], np.diff(np.append(starts, len(n))))
    out = run - base
    out[:end] = run[:end] + frag - (0 if used else 1)
    return out


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part; batches are sorted by part."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        part = b.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if held and held[-1].column("part")[0].as_py() != part[x]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def packed(places: DataFrame, size: int) -> DataFrame:
    """(k0, k1, h, frag_no) of places (k0: the file, k1: the block's number, h, occ, n, part)."""
    parts = max(places.select("part").distinct().count(), 1)
    own = places.withColumn("fid", F.xxhash64("k0", F.col("k0").isNull()))
    order = ["part", "k0", "k1", "h", "occ"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_part(batches):
            rows = [(t.column("part")[0].as_py(), *r) for r in summary(t.column("fid").to_numpy(), t.column("n").to_numpy(), size)]
            names = [c.split()[0] for c in PART.split(", ")]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({"part": "int32", "last_breaks": "Int64", "last_used": "Int64"}), preserve_index=False)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = (tuple(None if pd.isna(x) else x for x in r) for b in batches for r in b.itertuples(index=False, name=None))
        yield pd.DataFrame(list(fold(clean)), columns=["part", "used", "frag"])

    sorted_ = own.repartition(parts, "part").sortWithinPartitions(*order)
    # a few rows a part, in one task
    told = sorted_.select("part", "fid", "n").mapInArrow(tell, PART).repartition(1).sortWithinPartitions("part", "at_least")
    begun = {r.part: (r.used, r.frag) for r in told.mapInPandas(begin, "part int, used long, frag long").collect()}  # a row a part

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_part(batches):
            frag = fragments(t.column("fid").to_numpy(), t.column("n").to_numpy(), size, *begun[t.column("part")[0].as_py()])
            out = t.select(["k0", "k1", "h"]).append_column("frag_no", pa.array(frag, pa.int32()))
            yield from out.combine_chunks().to_batches()

    kinds = dict(places.dtypes)
    return sorted_.select("k0", "k1", "h", "fid", "n", "part").mapInArrow(place, f"k0 {kinds['k0']}, k1 {kinds['k1']}, h long, frag_no int")
