"""Periodic runs of words (operator 12): repeated k-gram masking, then Main-Lorentz.

A run of period q has at least max(least, times * q) words, so each of its k-grams stands a
second time q words away, as long as k is at most the length less 2 * q - 1; k is the least such
value over all q. A word outside every k-gram that its document holds twice can thus be in no run.
Only stretches of the words that are left, of at least `least` words, are searched: they are halved
again and again, and at each middle every possible period's extensions to both sides are compared.
All middles of one depth, in all texts of a batch, are taken at once, in arrays.

A row is worked on where it is read; nothing is shuffled, and no state outlives a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textcore import Words, _powers, mix, pieces, ranges, words_of

RUNS = "array<struct<start: long, length: long, period: long>>"


def overlap_k(least: int, times: int) -> int:
    """The longest k for which each k-gram of any run stands twice in it."""
    # from q = least on a run's length is times * q, which grows faster than 2 * q; times is at least 4, so k >= 1
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))


class Stretch:
    """Equality of stretches of words, by prefix sums of a polynomial hash."""

    def __init__(self, words: np.ndarray):
        up, self.down = _powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from x are those from y."""
        return (self.sums[x + n] - self.sums[x]) * self.down[x] == (self.sums[y + n] - self.sums[y]) * self.down[y]

    def forward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from x on are those from y on, at most `most`."""
        return self._longest(most, lambda n: self.same(x, y, n))

    def backward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before x are those before y, at most `most`."""
        return self._longest(most, lambda n: self.same(x - n, y - n, n))

    @staticmethod
    def _longest(most: np.ndarray, fits) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            ok = fits(half)
            low, high = np.where(ok, half, low), np.where(ok, high, half - 1)
        return low


def surviving(w: Words, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each stretch of at least `least` words of one text, all of them within
    k-grams that the text holds twice or more."""
    doc, at, h = w.windows(k)
    key = mix(h + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    twin = np.zeros(len(key), bool)
    same = key[order][1:] == key[order][:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, at[twin], 1)
    np.add.at(edge, at[twin] + k, -1)
    inside = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    # a stretch that goes on into the next text is cut there
    cuts = w.first[1:-1][inside[1:][w.first[1:-1]] & inside[:-1][w.first[1:-1]]] if len(w.first) > 2 else w.first[:0]
    start, end = np.unique(np.concatenate((start, cuts))), np.unique(np.concatenate((end, cuts)))
    long = end - start >= least
    return start[long], end[long]


@dataclass
class Runs:
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def runs_between(words: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, times: int) -> Runs:
    """All runs within the stretches [start, end), sorted by start, then period."""
    stretch, found = Stretch(words), [np.zeros((0, 3), np.int64)]
    lo, hi, left, right = start, end, start, end  # halves, and the stretches that they are of
    while len(lo):
        middle = (lo + hi) // 2
        n_periods = (hi - lo) // times
        node = np.repeat(np.arange(len(lo)), n_periods)
        q = ranges(np.ones(len(lo), np.int64), n_periods)
        m, l, r = middle[node], left[node], right[node]
        # at least half of a run over the middle lies on one of its sides, two periods there
        for side in (-1, 1):
            first, second = (m - 2 * q, m - q) if side < 0 else (m, m + q)
            ok = (first >= l) & (second + q <= r)
            first, second, p = first[ok], second[ok], q[ok]
            hit = stretch.same(first, second, p)
            first, second, p, l1, r1 = first[hit], second[hit], p[hit], l[ok][hit], r[ok][hit]
            # so these words are repeated a period later; how far to either side?
            a = first - stretch.backward(first, second, first - l1)
            b = second + stretch.forward(first, second, r1 - second)
            good = b - a >= np.maximum(least, times * p)
            found.append(np.stack((a[good], b[good], p[good]), axis=1))
        lo, hi = np.concatenate((lo, middle)), np.concatenate((middle, hi))
        left, right = np.concatenate((left, left)), np.concatenate((right, right))
        wide = hi - lo >= least
        lo, hi, left, right = lo[wide], hi[wide], left[wide], right[wide]
    runs = np.concatenate(found)
    # of the periods of one stretch the smallest; any other that was found is a multiple of it
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return Runs(runs[:, 0], runs[:, 1], runs[:, 2])


def _kept_texts(w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    doc = w.doc()[kept]
    start, size = w.start[kept], w.end[kept] - w.start[kept] + 1
    # each word with one byte after it, which becomes the space
    at = ranges(start, size)
    stop = np.cumsum(size)
    out = np.full(len(at), 0x20, np.uint8)
    word = np.ones(len(at), bool)
    word[stop - 1] = False
    out[word] = w.buf[at[word]]
    byte = np.concatenate(([0], stop))
    n_words = np.bincount(doc, minlength=len(w.first) - 1)
    border = byte[np.concatenate(([0], np.cumsum(n_words)))]
    # the last space of each text goes
    last = border[1:][n_words > 0] - 1
    out = np.delete(out, last)
    offsets = border - np.concatenate(([0], np.cumsum(n_words > 0)))
    return pa.Array.from_buffers(pa.large_string(), len(n_words), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """docs with n_words, runs and collapsed; columns of these names are replaced, all others kept.

    Words are runs of characters other than ASCII white space. A run is a stretch of words whose
    smallest period is q (words q apart are equal), of at least max(least, times * q) words, that
    no neighbouring word extends; runs has its start (a word number from 0), length and period, by
    start, then period. collapsed: the words that are in no run after its first q words, joined by
    one space. A null, empty or blank text has no words, no runs and an empty collapsed text. Texts
    are taken whole, however long; repeated rows are worked on each for itself; an empty table
    gives no rows.
    """
    if least < 2 or times < 4:
        raise ValueError("a run has at least two words and four periods: two on one side of a middle")
    k = overlap_k(least, times)
    small_batches(docs.sparkSession)
    others = docs.drop("n_words", "runs", "collapsed")
    own = others.select(F.struct(*others.columns).alias("row"), F.col(text).cast("string").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = words_of(b.column("text"))
            runs = runs_between(w.hash, *surviving(w, k, least), least, times)
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, runs.start + runs.period, 1)
            np.add.at(edge, runs.end, -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            doc = w.doc()[runs.start]
            n = np.bincount(doc, minlength=b.num_rows)
            parts = [pa.array(x, pa.int64()) for x in (runs.start - w.first[doc], runs.end - runs.start, runs.period)]
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(w.count(), pa.int64()), spans, _kept_texts(w, kept).cast(pa.string())], ["row", "n_words", "runs", "collapsed"])

    out = own.mapInArrow(search, f"row {own.schema['row'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")
    return out.select(*(F.col("row")[c].alias(c) for c in others.columns), "n_words", "runs", "collapsed")
