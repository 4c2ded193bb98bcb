"""Vectorised word handling for Arrow batches of texts.

Texts of a batch lie in one UTF-8 buffer. Word borders, word hashes and hashes of word
windows are computed on the whole buffer with numpy, so that no Python runs per word.

Hashes are 64-bit polynomial hashes over random byte codes. Two different words (or
windows) met in one comparison get the same hash with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(0x5EED)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_NO_ALNUM = np.zeros(256, bool)
_NO_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = -(-n // (1 << 18)) << 18
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def segment_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte segment of buf; equal bytes give equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODE[buf] * up[: len(buf)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, without regard to document borders."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= _GRAM
        out += words[j : len(words) - n + 1 + j]
    return mix(out)


@dataclass
class Words:
    """Words of several texts: bytes buf[start:end], hash, and for each text its first word."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than texts

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count())

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, hash) of each run of n words that lies in one text."""
        h = window_hash(self.hash, n)
        at = np.arange(len(h))
        doc = self.doc()
        ok = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
        return doc[: len(h)][ok], at[ok], h[ok]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and each one's start (one more than texts). Null: empty."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words_of(texts: pa.Array, kind: str = "space") -> Words:
    """kind "space": words are runs of bytes other than ASCII white space, unchanged;
    "space_lower": the same, A-Z lower-cased; "alnum": A-Z lower-cased, words are runs of
    a-z, 0-9 and all non-ASCII characters."""
    buf, off = buffer_of(texts)
    if kind != "space":
        buf = _LOWER[buf]
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~(_NO_ALNUM if kind == "alnum" else _WHITE)[buf]
    # a word begins where the one before is outside, or at a text's start
    head = inside[1:-1] & ~inside[:-2]
    tail = inside[1:-1] & ~inside[2:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    head[cuts] |= inside[cuts + 1]
    tail[cuts - 1] |= inside[cuts]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return Words(buf, start, end, segment_hash(buf, start, end), np.searchsorted(start, off))


def give_back() -> None:
    """Returns freed memory to the system: a worker stays, idle, beside stages of other kinds."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", n_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about n_bytes each; a longer text stands alone."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffer_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + n_bytes, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch
    give_back()


def join_texts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each segment."""
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... of every range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def sliding(h: np.ndarray, width: int, what=np.minimum) -> np.ndarray:
    """what (minimum or maximum) of each width successive values, by doubling."""
    out, span = h, 1
    while 2 * span <= width:
        out = what(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return what(out[:-rest], out[rest:]) if rest else out.copy()
