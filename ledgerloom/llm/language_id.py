"""Language identification by error-correcting output codes (operator 11).

Each language has a codeword of bits. For each bit a linear classifier over letter trigrams tells
the languages that have it from those that don't: a trigram's weight is the logarithm of its mean
share in the one group over that in the other. Shares come from counts over all labelled texts,
and so does each bit's weight, which follows from how often its classifier errs on them. A text's
bits are not rounded: each codeword's loss is the weighted sum of the logistic losses of its bits,
and the language of the smallest loss is taken. Where the runner-up is close the text is marked
as ambiguous.

Texts are counted where they are read; what is shuffled and sent on are a few thousand numbers a
language and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textcore import buffer_of, pieces

UNKNOWN = "und"
DIMS = 1 << 13
_LETTERS = np.zeros(256, np.int64)  # 0: no letter
_LETTERS[65:91] = _LETTERS[97:123] = np.arange(1, 27)
_LETTERS[128:] = np.arange(27, 155)
_BASE = 155
_FLOOR = 0.01  # share of a trigram count that is spread over all trigrams
_ROWS = 256  # texts whose counts are held at once


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of each letter with its two neighbours (a letter of the same word, or none).
    Letters are bytes of UTF-8: A-Z as a-z, U+00C0 to U+00DE as the small letters after them."""
    buf, off = buffer_of(texts)
    small = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    c = _LETTERS[buf]
    c[1:][small] += 0x20
    before, after = np.zeros_like(c), np.zeros_like(c)
    before[1:], after[:-1] = c[:-1], c[1:]
    some = off[:-1] < off[1:]
    before[off[:-1][some]] = 0
    after[off[1:][some] - 1] = 0
    at = np.flatnonzero(c)
    code = (before[at] * _BASE + c[at]) * _BASE + after[at]
    term = ((code.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - 13)
    return np.searchsorted(off, at, "right") - 1, term.astype(np.int64)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether any character of each text is a letter of any script."""
    buf, off = buffer_of(texts)
    run = np.concatenate(([0], np.cumsum((_LETTERS[buf] > 0) & (buf < 128))))
    out = run[off[1:]] > run[off[:-1]]
    wide = np.concatenate(([0], np.cumsum(buf >= 128)))
    for i in np.flatnonzero(~out & (wide[off[1:]] > wide[off[:-1]])).tolist():
        out[i] = any(c.isalpha() for c in texts[i].as_py())
    return out


def codewords(n: int) -> np.ndarray:
    """A row of bits (1 or -1) for each of n languages; no column is the same for all languages.
    Up to six languages: every way to part them in two. More: the one of 200 random codes of ten
    bits for each doubling of n whose two nearest codewords lie furthest apart."""
    if n < 2:
        return np.zeros((n, 0), np.int64)
    if n <= 6:
        parts = np.arange(1, 1 << (n - 1))
        # the first language has no bit set, so no column is another's opposite
        return np.stack([np.where((parts >> i) & 1, 1, -1) for i in range(n)][::-1])
    rng, width, best, apart = np.random.default_rng(11), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = np.where(rng.random((n, width)) < 0.5, -1, 1)
        flat = np.abs(code.sum(axis=0)) == n
        code[0, flat] *= -1
        near = (width - (code @ code.T)) // 2 + width * np.eye(n, dtype=np.int64)
        if near.min() > apart:
            best, apart = code, int(near.min())
    return best


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A row for each bit: the weight of each term. counts: a row for each language."""
    share = (1 - _FLOOR) * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) + _FLOOR / counts.shape[1]
    up, down = (code > 0).astype(float), (code < 0).astype(float)
    plus = (up.T @ share) / np.maximum(up.sum(axis=0), 1)[:, None]
    minus = (down.T @ share) / np.maximum(down.sum(axis=0), 1)[:, None]
    return (np.log(plus) - np.log(minus)).astype(np.float32)


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """A row for each text: the sum of its terms' weights for each bit, over the root of their number."""
    doc, term = trigrams(texts)
    counts = np.bincount(doc * DIMS + term, minlength=len(texts) * DIMS).reshape(len(texts), DIMS).astype(np.float32)
    n = counts.sum(axis=1, keepdims=True)
    return (counts @ weights.T) / np.sqrt(np.maximum(n, 1))


def losses(margin: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """A row for each text: the weighted loss of each language's codeword."""
    right, wrong = np.logaddexp(0, -margin), np.logaddexp(0, margin)
    return (right * trust) @ (code > 0).T + (wrong * trust) @ (code < 0).T


def bit_trust(errors: np.ndarray, n: int, bits: float) -> np.ndarray:
    """Weights of bits by their errors on n texts, the sum being the number of bits that are needed."""
    rate = (errors + 1) / (n + 2)
    trust = np.maximum(1 - 2 * rate, 0.01)
    return bits * trust / trust.sum() if len(trust) else trust


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def identify(docs: DataFrame, known: DataFrame, close: float = 0.2, most_languages: int = 1000) -> DataFrame:
    """docs (text, ...) with lang_pred, score, second and ambiguous; columns of these names are
    replaced, all others kept. known: (text, lang) of the texts that are learned from.

    score is the share of exp(-loss) that falls to lang_pred (0 to 1); second the language of the
    next larger loss (ties: the first in alphabetical order); ambiguous, whether their shares
    lie less than `close` apart. A null, empty or letterless text is "und" with a score of 0, as
    all are where nothing is known. Rows of known with a null lang or text are left out, repeated
    ones count again. With one language every text with a letter is of it, with a score of 1. More
    than most_languages languages are an error: the classifiers (8192 numbers a bit) are sent to
    each executor. Texts are taken whole, however long; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = known.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                term = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(term), pa.string()), "term": pa.array(term, pa.int32()), "n": n[term]})

        for b in pieces(batches):
            doc, term = trigrams(b.column("text"))
            names = b.column("lang").dictionary_encode()
            of = names.indices.to_numpy()[doc]
            for i, lang in enumerate(names.dictionary.to_pylist()):
                own = np.bincount(term[of == i], minlength=DIMS)
                held[lang] = held[lang] + own if lang in held else own
            if len(held) > 64:
                yield from out()
                held = {}
        yield from out()

    counted = known.mapInArrow(count, "lang string, term int, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most DIMS rows a language
    names = sorted(set(found.column("lang").to_pylist()))
    if len(names) > most_languages:
        raise ValueError(f"{len(names)} languages; at most {most_languages} are told apart")
    counts = np.zeros((len(names), DIMS))
    place = {x: i for i, x in enumerate(names)}
    counts[[place[x] for x in found.column("lang").to_pylist()], found.column("term").to_numpy()] = found.column("n").to_numpy()
    code = codewords(len(names))
    weights = bit_weights(counts, code)
    model = spark.sparkContext.broadcast((names, code, weights))

    def err(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, code, weights = model.value
        place = {x: i for i, x in enumerate(names)}
        wrong, n = np.zeros(code.shape[1], np.int64), 0
        for b in _slices(batches):
            lang = np.array([place.get(x, -1) for x in b.column("lang").to_pylist()])
            some = np.flatnonzero(lang >= 0)
            wrong += ((margins(b.column("text"), weights)[some] * code[lang[some]]) <= 0).sum(axis=0)
            n += len(some)
        yield pa.RecordBatch.from_pydict({"bit": pa.array(np.arange(-1, len(wrong)), pa.int32()), "n": np.concatenate(([n], wrong))})

    errors = np.zeros(code.shape[1] + 1)
    if code.shape[1]:
        for r in known.mapInArrow(err, "bit int, n long").groupBy("bit").agg(F.sum("n").alias("n")).collect():  # a row a bit
            errors[r.bit + 1] = r.n
    trust = spark.sparkContext.broadcast(bit_trust(errors[1:], int(errors[0]), 1 + np.log2(max(len(names), 1))))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, code, weights = model.value
        for b in _slices(batches):
            texts = b.column("text")
            some = has_letter(texts) & (len(names) > 0)
            lang = np.full(b.num_rows, UNKNOWN, object)
            second = np.full(b.num_rows, None, object)
            score, gap = np.zeros(b.num_rows), np.ones(b.num_rows)
            if some.any():
                loss = losses(margins(texts, weights), code, trust.value)
                order = np.argsort(loss, axis=1, kind="stable")
                share = np.exp(loss.min(axis=1, keepdims=True) - loss)
                share /= share.sum(axis=1, keepdims=True)
                rows = np.arange(b.num_rows)
                lang[some] = np.array(names, object)[order[:, 0]][some]
                score[some] = share[rows, order[:, 0]][some]
                if len(names) > 1:
                    second[some] = np.array(names, object)[order[:, 1]][some]
                    gap[some] = (share[rows, order[:, 0]] - share[rows, order[:, 1]])[some]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(second, pa.string()), pa.array(gap < close)],
                ["row", "lang_pred", "score", "second", "ambiguous"],
            )

    others = docs.drop("lang_pred", "score", "second", "ambiguous")
    own = others.select(F.struct(*others.columns).alias("row"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(predict, f"row {own.schema['row'].dataType.simpleString()}, lang_pred string, score double, second string, ambiguous boolean")
    return out.select(*(F.col("row")[c].alias(c) for c in others.columns), "lang_pred", "score", "second", "ambiguous")
