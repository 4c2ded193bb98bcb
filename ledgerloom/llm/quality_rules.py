"""Quality rules and n-gram perplexity (operator 10).

The language model is a modified Kneser-Ney model over bytes (ASCII white space as a space), one
for each language. Documents are in two folds by hash of the text, and each is scored by the
model that counted the other fold, so no text predicts itself. Spark counts the n-grams of all
documents; continuation counts, discounts and interpolated probabilities are DataFrame
aggregations and joins over the distinct n-grams, and nothing is pruned. The model is written as
arrays sorted by hash, in files by range of hashes, which the scoring tasks memory-map where the
shared folder is a mounted one (else they read file after file).

Perplexity counts for each word (a run of letters and digits), so that marks and signs between
words make it larger.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, fresh_dir, read_array, settle, small_batches, write_array
from .textcore import _NO_ALNUM, _WHITE, buffer_of, give_back, mix, pieces, segment_hash, words_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_HELD = 1 << 20  # n-grams that a task gathers before it passes them on
_SENT = 1 << 17  # n-grams passed on at once
_SLICE = 1 << 18  # bytes of text taken at once: each byte takes about a hundred bytes of arrays
_FILE = 1 << 18  # n-grams of a file of the model, about
_OPEN = 16  # files of the model that a task holds open
SPREAD = 0.2  # distance of the lower quartile from the median in languages of many documents, about


def _models(langs: pa.Array, buf: np.ndarray, off: np.ndarray, other: int = 0) -> np.ndarray:
    """64-bit code of each text's language and fold; a null language is the empty one. The fold is
    one bit of a hash of the text's words, so texts that differ in white space alone have one.
    With other = 1 it is that of the texts that the counts are for: the one that a text isn't in."""
    names, at = buffer_of(langs.fill_null(""))
    solid = np.concatenate(([0], np.cumsum(~_WHITE[buf])))
    fold = segment_hash(buf[~_WHITE[buf]], solid[off[:-1]], solid[off[1:]]) >> np.uint64(63)
    return (segment_hash(names, at[:-1], at[1:]) & ~np.uint64(1)) | (fold ^ np.uint64(other))


def _grams(buf: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """The last order bytes at each byte of the texts. Zero bytes stand before a text."""
    count = np.diff(off)
    clean = np.where(_WHITE[buf] | (buf == 0), np.uint8(0x20), buf)
    pad = order - 1
    long = np.zeros(len(buf) + pad * len(count), np.uint8)
    place = np.arange(len(buf), dtype=np.int32) + np.repeat(np.arange(1, len(count) + 1, dtype=np.int32) * np.int32(pad), count)
    long[place] = clean
    key = np.zeros(len(buf), np.uint64)
    for j in range(pad, -1, -1):
        key <<= np.uint64(8)
        key |= long[place - np.int32(j)]
    return key


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    ranks = np.argsort(keys, kind="stable")
    keys = keys[ranks]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[head], np.add.reduceat(n[ranks], head)


def ngram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(model, gram, n) of all documents, each counted for the fold that it isn't in."""
    bits = np.uint64(8 * order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[int, int] = {}  # of each model met in this task
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            models = np.array(list(number), np.uint64).view(np.int64)
            for lo in range(0, len(keys), _SENT):
                k = keys[lo : lo + _SENT]
                gram = (k & np.uint64((1 << 8 * order) - 1)).view(np.int64)
                yield pa.RecordBatch.from_pydict({"model": models[(k >> bits).astype(np.int64)], "gram": gram, "n": n[lo : lo + _SENT]})

        for b in pieces(batches, n_bytes=_SLICE):
            buf, off = buffer_of(b.column("text"))
            if not len(buf):
                continue
            model = _models(b.column("lang"), buf, off, 1)
            if len(number) + len(model) >= 1 << (64 - 8 * order):  # no more numbers beside the grams
                if parts:
                    yield from out(*_merged(parts))
                parts.clear()
                number.clear()
            own = np.array([number.setdefault(x, len(number)) for x in model.tolist()], np.uint64)
            keys = _grams(buf, off, order) | (np.repeat(own, np.diff(off)) << bits)
            parts.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in parts) > _HELD:
                parts = [_merged(parts)]
                if len(parts[0][0]) > _HELD // 2:
                    yield from out(*parts.pop())
        if parts:
            yield from out(*_merged(parts))
        parts = keys = None
        give_back()

    found = docs.select("text", "lang").mapInArrow(count, "model long, gram long, n long")
    return found.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int) -> list[DataFrame]:
    """For orders 0 (a model's root) to order: (model, gram, logp, backoff). logp: natural logarithm
    of the interpolated probability (null: the gram is a context only); backoff: that of the weight
    left to the next lower order after this gram (0 where it is no context)."""
    levels = [settle(counts, "grams")]
    for m in range(order, 1, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1))
        levels.insert(0, settle(levels[0].groupBy("model", suffix.alias("gram")).agg(F.count("*").alias("n")), "grams"))
    weights, probs = [], []
    for m, level in enumerate(levels, 1):
        few = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        d = level.groupBy("model").agg(*few)
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
        cut = [F.greatest(F.least(i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1)), F.lit(i - 0.05)), F.lit(0.05)).alias(f"d{i}") for i in (1, 2, 3)]
        terms = level.join(bounded(d.select("model", *cut), "discounts"), "model")  # two rows a language
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        terms = terms.select("model", "gram", F.shiftrightunsigned("gram", 8).alias("context"), "n", off.alias("off"))
        sums = terms.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("gamma"))
        terms = terms.join(sums, ["model", "context"])
        if m == 1:
            lower = F.lit(1 / 256)
        else:
            low = F.col("gram").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1))
            terms = terms.withColumn("low", low).join(probs[-1].select("model", F.col("gram").alias("low"), F.col("p").alias("p_low")), ["model", "low"])
            lower = F.col("p_low")
        probs.append(settle(terms.select("model", "gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("gamma") * lower).alias("p")), "p"))
        weights.append(sums.select("model", F.col("context").alias("gram"), F.log("gamma").alias("backoff")))
    out = [weights[0].select("model", "gram", F.lit(None).cast("double").alias("logp"), "backoff")]
    for m in range(1, order + 1):
        table = probs[m - 1].select("model", "gram", F.log("p").alias("logp"))
        table = table.join(weights[m], ["model", "gram"], "full_outer") if m < order else table.withColumn("backoff", F.lit(0.0))
        out.append(table.select("model", "gram", "logp", F.coalesce("backoff", F.lit(0.0)).alias("backoff")))
    return out


def _hashes(model: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return mix(gram ^ mix(model))


def write_model(levels: list[DataFrame], folder: str) -> list[int]:
    """Writes each level in files by hash range, each file sorted by hash: for each level the
    number of bits that tell files apart. The driver sees a count for each level."""
    bits = []
    for m, level in enumerate(levels):
        level = settle(level, "level")
        bits.append(max(0, (level.count() // _FILE).bit_length()))

        def hashed(batches: Iterator[pa.RecordBatch], n_bits: int = bits[m]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                model, gram = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("model", "gram"))
                h = _hashes(model, gram)
                file = (h >> np.uint64(64 - n_bits)).astype(np.int64) if n_bits else np.zeros(len(h), np.int64)
                logp, backoff = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in ("logp", "backoff"))
                yield pa.RecordBatch.from_pydict({"file": file, "h": h.view(np.int64), "logp": logp, "backoff": backoff})

        def write(batches: Iterator[pa.RecordBatch], m: int = m) -> Iterator[pa.RecordBatch]:
            file, held, done = None, [], []

            def close() -> None:
                h = np.concatenate([x for x, _ in held])
                ranks = np.argsort(h)
                write_array(f"{folder}/v{m}-{file}.bin", np.concatenate([x for _, x in held])[ranks])
                write_array(f"{folder}/h{m}-{file}.bin", h[ranks])
                done.append(file)

            for b in batches:
                of = b.column("file").to_numpy()
                h = b.column("h").to_numpy().view(np.uint64)
                v = np.stack([b.column(c).to_numpy() for c in ("logp", "backoff")], axis=1)
                cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                    if lo < hi and of[lo] != file:
                        if held:
                            close()
                        file, held = int(of[lo]), []
                    held.append((h[lo:hi], v[lo:hi]))
            if held:
                close()
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(done)], pa.int64())})

        found = level.mapInArrow(hashed, "file long, h long, logp float, backoff float")
        found = found.repartition(1 << min(bits[m], 10), "file").sortWithinPartitions("file")
        found.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return bits


class Model:
    """The written model. Hashes that are looked up are sorted first, so each file is opened
    once for all of them."""

    def __init__(self, folder: str, bits: list[int]) -> None:
        self.folder, self.bits, self.open = folder, bits, OrderedDict()

    def _file(self, m: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        if (m, i) not in self.open:
            try:
                self.open[m, i] = (read_array(f"{self.folder}/h{m}-{i}.bin", np.uint64), read_array(f"{self.folder}/v{m}-{i}.bin", np.float32).reshape(-1, 2))
            except FileNotFoundError:  # no gram has a hash of this range
                self.open[m, i] = (np.zeros(0, np.uint64), np.zeros((0, 2), np.float32))
            while len(self.open) > _OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end((m, i))
        return self.open[m, i]

    def find(self, m: int, model: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """logp and backoff of each gram of level m; NaN where there is none."""
        out = np.full((len(gram), 2), np.nan)
        h = _hashes(model, gram)
        ranks = np.argsort(h)
        h = h[ranks]
        of = (h >> np.uint64(64 - self.bits[m])).astype(np.int64) if self.bits[m] else np.zeros(len(h), np.int64)
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
            hashes, values = self._file(m, int(of[lo])) if lo < hi else ((), ())
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(hashes, h[lo:hi]), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h[lo:hi])
            out[ranks[lo:hi][hit]] = values[at[hit]]
        return out

    def logp(self, model: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Of each gram of the highest order; a gram not seen backs off to lower orders."""
        _, first, back = np.unique(_hashes(model, keys), return_index=True, return_inverse=True)
        model, key = model[first], keys[first]
        out, open_ = np.zeros(len(key)), np.arange(len(key))
        for m in range(len(self.bits) - 1, 0, -1):
            found = self.find(m, model, key)[:, 0]
            hit = ~np.isnan(found)
            out[open_[hit]] += found[hit]
            open_, model, key = open_[~hit], model[~hit], key[~hit]
            if not len(open_):
                break
            out[open_] += np.nan_to_num(self.find(m - 1, model, key >> np.uint64(8))[:, 1])
            key = key & np.uint64((1 << 8 * (m - 1)) - 1)
        out[open_] += np.log(1 / 256)
        return out[back]


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = words_of(texts)
    buf, off = buffer_of(texts)

    def summed(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(mask)))
        return run[off[1:]] - run[off[:-1]]

    solid = ~_WHITE[buf]
    out = {"n_words": w.count(), "word_chars": summed(solid & ((buf & 0xC0) != 0x80)), "n_symbols": summed(_SYMBOL[buf])}
    newline = np.flatnonzero(buf == 0x0A)
    line_start = np.union1d(newline + 1, off[:-1])
    line_start = line_start[line_start < len(buf)]
    doc = np.searchsorted(off, line_start, "right") - 1
    line_end = np.minimum(np.append(newline, len(buf))[np.searchsorted(newline, line_start)], off[doc + 1])
    run = np.concatenate(([0], np.cumsum(solid)))
    some = run[line_end] > run[line_start]
    line_start, line_end, doc = line_start[some], line_end[some], doc[some]
    key = np.unique(np.stack((doc.astype(np.uint64), segment_hash(buf, line_start, line_end))), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
    n = len(off) - 1
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(key[0].astype(np.int64), minlength=n)
    doc, at, h = w.windows(8)
    own = mix(h + mix(doc.astype(np.uint64) + np.uint64(1)))
    ranks = np.argsort(own, kind="stable")
    same = own[ranks][1:] == own[ranks][:-1]
    twice = np.zeros(len(own), bool)
    twice[ranks[1:][same]] = True
    twice[ranks[:-1][same]] = True
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 8, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
    out["n_repeat_words"] = covered[w.first[1:]] - covered[w.first[:-1]]
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _alnum_words(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The number of each text's runs of letters and digits."""
    inside = ~_NO_ALNUM[np.where((buf >= 65) & (buf <= 90), buf | np.uint8(32), buf)]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    begins = off[:-1][np.diff(off) > 0]
    head[begins] = inside[begins]
    run = np.concatenate(([0], np.cumsum(head)))
    return run[off[1:]] - run[off[:-1]]


def scored(docs: DataFrame, order: int = 5) -> DataFrame:
    """docs (text, lang; all columns are kept, those named below replaced) with the base
    measures, base_failed and ppl (perplexity a word; null without text).

    Null text is empty, and fails; null lang is the language of an empty name; repeated rows
    count each; an empty table gives no rows; texts are taken whole, however long.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*BASE, "base_failed", "ppl", "ppl_low", "ppl_high", "kept")
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumn("lang", F.col("lang").cast("string"))
    folder = fresh_dir(spark, "kneser-ney")
    bits = write_model(kneser_ney(ngram_counts(rows, order), order), folder)
    fields = ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, ppl double"
    schema = spark.createDataFrame([], fields).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, bits)
        for b in pieces(batches, n_bytes=_SLICE):
            m = measures(b.column("text"))
            buf, off = buffer_of(b.column("text"))
            size = np.diff(off)
            logp = model.logp(np.repeat(_models(b.column("lang"), buf, off), size), _grams(buf, off, order))
            run = np.concatenate(([0.0], np.cumsum(logp)))
            mean = (run[off[1:]] - run[off[:-1]]) / np.maximum(_alnum_words(buf, off), 1)
            failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            ppl = pa.array(np.exp(np.minimum(-mean, 700)), mask=size == 0)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m[c], pa.int64()) for c in BASE), pa.array(failed), ppl], [*b.schema.names, *schema.names])
        model = logp = run = m = None
        give_back()

    return rows.mapInArrow(score, type(schema)(rows.schema.fields + schema.fields))


def judged(rows: DataFrame, lower: float = 12.0, upper: float = 12.0, least: int = 30, small: bool = False) -> DataFrame:
    """Rows of scored(), which are read twice, with ppl_low, ppl_high (the band of the
    document's language) and kept.

    The band of a language lies around the median of the logarithm of perplexity, over all its
    documents that pass the base rules: lower and upper times the distance of the lower quartile
    from the median, which bad text above doesn't move. Above the band lies text that is unlike its
    language, below it text that is all too foreseeable, such as frequent words in any order;
    near copies of a text are in the other fold, too, and lie below others, but within it.

    A language of fewer than `least` such documents has no band, and these stay, unless `small` asks
    for it: then its band lies around its own median, and the distance is its own, the mean one of
    such languages (by documents) or SPREAD, whichever is most, as a quartile of few is chance. A
    language's only document is its median, and stays.
    """
    lang = F.coalesce(F.col("lang"), F.lit(""))
    log = F.log("ppl")
    sound = rows.where(~F.col("base_failed") & F.col("ppl").isNotNull())
    bands = sound.groupBy(lang.alias("lang")).agg(F.percentile_approx(log, [0.25, 0.5], 10000).alias("q"), F.count("*").alias("n"))
    bands = bounded(bands.select("lang", "n", F.col("q")[1].alias("median"), (F.col("q")[1] - F.col("q")[0]).alias("apart")), "quartiles")
    few = F.col("n") < least
    if small:
        mean = bands.where(few).agg((F.sum(F.col("n") * F.col("apart")) / F.sum("n")).alias("mean"))
        bands = bands.crossJoin(F.broadcast(mean)).withColumn("apart", F.when(few, F.greatest("apart", "mean", F.lit(SPREAD))).otherwise(F.col("apart")))
    low, high = F.exp(F.col("median") - lower * F.col("apart") - 0.05), F.exp(F.col("median") + upper * F.col("apart") + 0.05)
    bands = bounded(bands.where(F.lit(True) if small else ~few).select("lang", low.alias("ppl_low"), high.alias("ppl_high")), "bands")
    out = rows.alias("r").join(bands.alias("b"), F.coalesce(F.col("r.lang"), F.lit("")) == F.col("b.lang"), "left")
    out = out.select("r.*", "b.ppl_low", "b.ppl_high")
    inside = F.coalesce(F.col("ppl").between(F.col("ppl_low"), F.col("ppl_high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)
