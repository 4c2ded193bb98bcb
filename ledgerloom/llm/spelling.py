"""Grouping of spelling variants (operator 13): words that differ by one letter.

Where two words differ by one error, one half of the word stands as it is: the letters before the
error or those after it. So each word is looked up twice, in an automaton over the sorted words
with its first half exact and the error after it, and in one over the reversed words with its last
half exact. What both find is put together. Words are passed on by their numbers, which follow
the order of code points.

The sorted words are cut into shards of SHARD words, by number, so however many there are an
automaton stays small; each is built by one task and written to the shared folder. A word asks
the shard that it lies in, and those others in which words begin with its half as well: such a
shard's first or last word begins so, which is an equal join with the few beginnings of border
words. Words are distinct, so no shard is larger than any other; a half that begins more words
than fill a shard sends its words to each of its shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .automata import Automaton, Letters
from .shared import fresh_dir, settle, small_batches
from .textcore import _LOWER, buffer_of, pieces, segment_hash

SHARD = 50_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LEAD = 0xC3  # in UTF-8 the first byte of U+00C0 to U+00FF, and of nothing else

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc32_after(heads: list[bytes], of: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, short: int = 64) -> np.ndarray:
    """The unsigned crc32 of heads[of] followed by buf[start:end], of each segment."""
    begun = np.array([zlib.crc32(h) for h in heads], np.uint32)
    out = begun[of]
    size = end - start
    for i in np.flatnonzero(size > short).tolist():
        out[i] = zlib.crc32(buf[start[i] : end[i]].tobytes(), int(out[i]))
    order = np.flatnonzero(size <= short)
    order = order[np.argsort(-size[order], kind="stable")]
    state, at, size = ~out[order], start[order], size[order]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # those longer than j
        state[:n] = _CRC[(state[:n] ^ buf[at[:n] + j]) & 255] ^ (state[:n] >> 8)
    out[order] = ~state
    return out


def latin_words(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """(word, n): how often each word stands in the texts of docs (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. With
    damage, a run loses a letter where damage divides the crc32 h of "doc_id:run": that at
    place h modulo its length; of a null doc_id none does. What is left of a run of one letter
    isn't counted. Null and empty texts have no words; texts are taken whole, however long; an
    empty table gives no rows. Counts are summed in each task before they are shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, n_bytes=2 << 20):
            raw, off = buffer_of(b.column("text"))
            buf = _LOWER[raw]
            inside = np.zeros(len(buf) + 2, bool)
            inside[1:-1] = _LETTER[buf]
            inside[2:-1] |= buf[:-1] == _LEAD
            cut = np.zeros(len(buf) + 1, bool)
            cut[off] = True
            start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
            end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
            damaged = np.zeros(0, np.int64)
            if damage:
                ids = b.column("doc_id").to_pylist()
                doc = np.searchsorted(off, start, "right") - 1
                h = crc32_after([f"{i}:".encode() for i in ids], doc, buf, start, end)
                known = np.array([i is not None for i in ids], bool)
                damaged = np.flatnonzero((h % damage == 0) & known[doc]) if len(h) else damaged
            extra = []
            for i in damaged.tolist():
                word = buf[start[i] : end[i]].tobytes().decode()
                at = int(h[i]) % len(word)
                extra.append(word[:at] + word[at + 1 :])
            start, end = np.delete(start, damaged), np.delete(end, damaged)
            _, one, n = np.unique(segment_hash(buf, start, end), return_index=True, return_counts=True)
            whole = buf.tobytes()
            words = [whole[x:y].decode() for x, y in zip(start[one].tolist(), end[one].tolist(), strict=True)] + [x for x in extra if x]
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": np.append(n, np.ones(len(words) - len(n), np.int64))})

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbered(df: DataFrame, order: str, name: str, as_name: str) -> DataFrame:
    """df with as_name: each row's place (from 0) in the order of the column, whose values are
    distinct. Partitions are counted (one row each), so no task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down, so that what a partition holds stays the same when a task runs again
    placed = settle(df.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order))
    out = placed.withColumn("rank", rank).join(F.broadcast(bases), F.col("part") == F.col("p"))
    return out.withColumn(as_name, F.col("base") + F.col("rank") - 1).drop("part", "p", "base", "rank")


def _build(dictionary: DataFrame, folder: str) -> None:
    """Writes an automaton for each shard of dictionary (shard, place, word, number, n)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, done = None, [], []

        def close() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            words = pa.concat_arrays(t.column("word").chunks)
            note = np.stack((t.column("number").to_numpy(), t.column("n").to_numpy()), axis=1)
            Automaton.build(Letters.of(words), note).save(f"{folder}/{shard}.dawg")
            done.append(shard)

        for b in batches:
            own = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if own[x] != shard and held:
                    close()
                    held = []
                shard = int(own[x])
                held.append(b.slice(x, y - x))
        if held:
            close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array(done, pa.int64())})

    dictionary.repartition("shard").sortWithinPartitions("shard", "place").mapInArrow(build, "shard long").agg(F.count("*")).collect()


def _asked(words: DataFrame, half: Column, size: int) -> DataFrame:
    """(shard, number, word, exact) of each look-up. words: word as it is asked, place, number."""
    own = words.select((F.col("place") / size).cast("long").alias("shard"), "number", "word", half.alias("exact"))
    ends = own.groupBy("shard").agg(F.min("word").alias("a"), F.max("word").alias("z")).select("shard", F.explode(F.array("a", "z")).alias("word"))
    # lengths of halves: fewer than the square root of twice the letters of all words
    lengths = [r.exact for r in own.select("exact").distinct().collect()]
    sizes = F.filter(F.array(*(F.lit(i) for i in lengths)).cast("array<int>"), lambda i: i <= F.length("word"))
    # a shard of other words that begin with a word's half has it as the beginning of a border word
    border = ends.select(F.col("shard").alias("other"), F.explode(F.transform(sizes, lambda i: F.substring("word", F.lit(1), i))).alias("half")).distinct()
    beyond = own.join(border, (F.substring("word", F.lit(1), F.col("exact")) == F.col("half")) & (F.col("shard") != F.col("other")))
    return own.unionByName(beyond.select(F.col("other").alias("shard"), "number", "word", "exact"))


def _ask(asked: DataFrame, folder: str, letters: int = 1 << 16) -> DataFrame:
    """(number, near, n): the words that the automata find for each look-up; so many letters are
    looked up at once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, machine = None, None
        for b in batches:
            own = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x < y and own[x] != shard:
                    shard = int(own[x])
                    machine = Automaton.load(f"{folder}/{shard}.dawg")
                upto = np.cumsum(np.asarray(pc.utf8_length(b.column("word").slice(x, y - x)), np.int64))
                at = x
                while at < y:
                    done = int(upto[at - x - 1]) if at > x else 0
                    stop = max(at + 1, x + int(np.searchsorted(upto, done + letters, "right")))
                    part = b.slice(at, stop - at)
                    at = stop
                    query, found = machine.one_error(Letters.of(part.column("word")), part.column("exact").to_numpy().astype(np.int64))
                    near = machine.note[found]
                    yield pa.RecordBatch.from_pydict({"number": part.column("number").to_numpy()[query], "near": near[:, 0], "n": near[:, 1]})

    # look-ups of one shard are split over up to 16 tasks, which all read its file
    parts = asked.repartition("shard", F.pmod("number", F.lit(16))).sortWithinPartitions("shard")
    return parts.mapInArrow(ask, "number long, near long, n long")


def near_words(words: DataFrame, size: int = SHARD) -> DataFrame:
    """(number, near, n): pairs of words that differ by one letter, each both ways and once, by
    number; n is the near word's. words: distinct word, n, number in the order of code points."""
    found = None
    small_batches(words.sparkSession)
    for name in ("forward", "backward"):
        if name == "forward":
            own = words.withColumn("place", F.col("number"))
        else:
            own = settle(numbered(words.withColumn("word", F.reverse("word")), "word", "reversed", "place"), name)
        folder = fresh_dir(words.sparkSession, f"{name}-automata")
        _build(own.select((F.col("place") / size).cast("long").alias("shard"), "place", "word", "number", "n"), folder)
        n = F.length("word")
        first = F.floor(n / 2).cast("int")
        pairs = _ask(_asked(own, first if name == "forward" else n - first, size), folder)
        found = pairs if found is None else found.unionByName(pairs)
    # dealt out by the first word alone, so what is counted by it needs no further shuffle
    return found.repartition("number").dropDuplicates(["number", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(number, root) from (number, form): forms followed to the last, in steps twice as long each
    time. A chain must not come back to its start."""
    out = settle(forms.select("number", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not out.where("moved").isEmpty():
        further = out.select(F.col("number").alias("at"), F.col("root").alias("then"))
        out = settle(out.join(further, F.col("root") == F.col("at"), "left").select("number", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots")
    return out.select("number", "root")


def spelling_forms(words: DataFrame, ratio: int = 2, size: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of words (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point;
    n_near is how many near words a word has. Its form is the one of largest n (ties: the smallest
    in the order of code points), if that n is at least ratio (more than 1) times its own, else
    null; root is the last form reached from it, or the word itself. Repeated rows of a word add
    up, a null n counts 0, null words are left out; other columns too. Words may be of any letters
    and any length; the empty word is near those of one letter. An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("a form's n is more than the word's own")
    known = words.where(F.col("word").isNotNull()).groupBy(F.col("word").cast("string").alias("word")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    known = settle(numbered(known, "word", "words", "number"), "numbered")
    pairs = near_words(known, size)
    best = F.max_by(F.struct("near", "n"), F.struct("n", -F.col("near")))
    near = settle(pairs.groupBy("number").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    own = known.join(near, "number", "left")
    enough = F.col("best.n") >= ratio * F.col("n")
    own = settle(own.select("number", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("f"), F.when(enough, F.col("best.n")).alias("form_n")), "forms")
    last = roots(own.where("f IS NOT NULL").select("number", F.col("f").alias("form")))
    named = known.select(F.col("number").alias("id"), F.col("word").alias("name"))
    chained = own.where("f IS NOT NULL").join(last, "number")
    chained = chained.join(named.withColumnRenamed("name", "form"), F.col("f") == F.col("id")).drop("id")
    chained = chained.join(named.withColumnRenamed("name", "end"), F.col("root") == F.col("id"))
    out = chained.select("word", "form", F.col("end").alias("root"), "n", "n_near", "form_n")
    alone = own.where("f IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return out.unionByName(alone)
