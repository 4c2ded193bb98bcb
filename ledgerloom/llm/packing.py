"""Best-fit packing of token sequences (operator 5), in bulk-synchronous rounds.

Pieces go by falling length, in classes of one octave each, the short ones together. A round takes all pieces of the class
and all gaps (the free ends of open sequences; a gap that holds several pieces of the class is
so many slots), range-sorts them into one list by size, and matches them by a successor sweep:
each slot, the smallest first, takes the largest piece before it that no smaller slot has taken.
In the list, with a step up at each piece and down at each slot, these are brackets: a piece and
its slot have the same height, and stand next to one another among all of that height. Heights
are prefix sums over the partitions, so conflicts are resolved by rank without a sequential
pass, and a height holds at most two items for each size, whatever the number of pieces. Gaps are
updated, and rounds repeat until no piece of the class finds a slot; then new sequences are
opened, never more than the tokens that are left need at least, or one for each piece of more
than half a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, small_batches
from .tokens import SLICE, crc32, encoder, pieces, with_end

ITEMS = 100_000  # pieces and slots of a partition of a round
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Cuts each document's ids (with the end id) into pieces of capacity ids; the first
    may be shorter. Null texts count as empty. Other columns are left out."""

    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, True)
        for b in pieces(batches, n_bytes=SLICE):
            ids, count = with_end(*code.encode(b.column("text")), end_id)
            run = np.concatenate(([0], np.cumsum(count)))
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, lo, n in zip(b.column("doc_id").to_pylist(), run.tolist(), count.tolist(), strict=False):
                first = n % capacity or capacity
                for i, at in enumerate([0, *range(first, n, capacity)]):
                    to = first if not i else at + capacity
                    for k, v in zip(out, (doc, i, at, to - at, crc32(ids[lo + at : lo + to])), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()})
        code.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def _matched(some: DataFrame, slots: DataFrame, n: int) -> DataFrame:
    """(rank, length, seq) of the pieces (rank, length) that slots (seq, slot, size) take."""
    items = some.select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("rank").alias("id"), F.lit(0).alias("slot"))
    items = items.unionByName(slots.select("size", F.lit(1).alias("kind"), F.col("seq").alias("id"), F.col("slot").cast("int").alias("slot")))
    order = ["size", "kind", "id", "slot"]
    # written, so that what a partition holds stays the same when a task runs again
    items = settle(items.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "items")
    step = F.when(F.col("kind") == 0, 1).otherwise(-1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = items.groupBy("part").agg(F.sum(step).alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a row for each partition
    run = items.join(F.broadcast(bases), "part").withColumn("height", F.col("base") + F.sum(step).over(within) + F.col("kind"))
    level = Window.partitionBy("height").orderBy(*order)
    last = run.withColumn("last", F.lag(F.struct("kind", "id", "size")).over(level)).where("kind = 1 and last.kind = 0")
    return last.select(F.col("last.id").alias("rank"), F.col("last.size").alias("length"), F.col("id").alias("seq"))


def best_fit(left: DataFrame, capacity: int) -> DataFrame:
    """(rank, sequence_id, offset) of each of left (rank, length): rank tells pieces apart, no
    length is more than capacity. The driver sees a few sums for each round."""
    spark = left.sparkSession
    gaps, opened, placed = spark.createDataFrame([], "seq long, gap long"), 0, []
    while True:
        most, tokens = left.agg(F.max("length"), F.sum("length")).first()
        if most is None:
            break
        low = most // 2 if most > capacity // 16 else 0  # the last class takes all short pieces
        own, left = left.where(F.col("length") > low), settle(left.where(F.col("length") <= low), "left")

        def opening(count: int, sum_: int, long: int, free: int) -> tuple[DataFrame, int]:
            need = max(-(-sum_ // capacity), -(-(tokens - free) // capacity))
            new = max(long, min(need, -(-count // (capacity // most))))
            more = spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
            return gaps.unionByName(more), opened + new

        while True:
            count, sum_, long = own.agg(F.count("*"), F.sum("length"), F.count_if(F.col("length") > capacity // 2)).first()
            if not count:
                break
            free, wide = gaps.agg(F.sum("gap"), F.sum(F.when(F.col("gap") > low, F.greatest(F.floor(F.col("gap") / most), F.lit(1))))).first()
            if not wide:
                gaps, opened = opening(count, sum_, long, free or 0)
                continue
            each = F.greatest(F.floor(F.col("gap") / most), F.lit(1))
            slots = gaps.where(F.col("gap") > low).select("seq", F.floor(F.col("gap") / each).alias("size"), F.explode(F.sequence(F.lit(0), each.cast("int") - 1)).alias("slot"))
            found = _matched(own, slots, -(-(count + wide) // ITEMS)).join(gaps, "seq")
            before = Window.partitionBy("seq").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
            offset = capacity - F.col("gap") + F.coalesce(F.sum("length").over(before), F.lit(0))
            found = settle(found.select("rank", "length", F.col("seq").alias("sequence_id"), offset.alias("offset")), "placed")
            used = found.groupBy(F.col("sequence_id").alias("seq")).agg(F.sum("length").alias("used"))
            if filled := found.agg(F.sum("length")).first()[0]:
                placed.append(found)
                tokens -= filled
                own = settle(own.join(found.select("rank"), "rank", "left_anti"), "left")
                gaps = settle(gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
                continue
            gaps, opened = opening(count, sum_, long, free or 0)
    every = spark.createDataFrame([], "rank long, length long, sequence_id long, offset long")
    for table in placed:
        every = every.unionByName(table)
    return every.drop("length")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most capacity ids; a row for each piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows with the same doc_id are packed each for itself; null ids and texts are kept (a null
    text is the end id alone); other columns, whatever their names, are left out; texts are
    taken whole, however long; an empty table gives no rows.
    """
    # written first, so that each piece keeps its number and texts are encoded once
    cut = settle(token_pieces(docs, tokenizer, end_id, capacity).withColumn("rank", F.monotonically_increasing_id()), "cut")
    places = best_fit(cut.select("rank", "length"), capacity)
    return cut.join(places, "rank").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
