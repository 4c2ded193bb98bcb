"""Intake of arriving files into a batch's store.

Files arrive as rows (path, sha, seq, ...): a path may come again with other contents (a later seq),
a content under another path. A keyed state tells, for each path, what was seen last, so that only
what is new goes on. Results are kept by content: a content is worked on once, whatever
its names. The store after any number of micro-batches, and restarts in the middle of one, is that
of one batch run over the last version of each path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.batches import pending_files
from ..sources.store import read_if_there, replace_results, save_results, saved_results, written

#: Takes contents (file_id, ...) and gives (file_id, ...), a row at least for each; file_id is the sha.
Work = Callable[[DataFrame], DataFrame]
_FOUND = "versions int, previous string"
#: Fixed value: the name of the state store that keyed state of this kind needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastSeen(StatefulProcessor):
    """For each path the sha and seq seen last; passes on a row whose sha is another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "sha string, seq long, versions int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, held, at = None, None, 0
        for part in rows:
            # of several rows of one seq the largest sha, as in latest_versions
            seq, sha = part["seq"].to_numpy(), part["sha"].to_numpy()
            top = max(np.flatnonzero(seq == seq.max()), key=sha.__getitem__)
            if newest is None or (int(seq[top]), sha[top]) > newest:
                newest, held, at = (int(seq[top]), sha[top]), part, top
        sha, seq, versions = self.seen.get() or (None, None, 0)
        if seq is not None and newest <= (seq, sha):
            return  # an older version that comes late, or the same once more
        fresh = sha != newest[1]
        self.seen.update((newest[1], newest[0], versions + fresh))
        if fresh:
            yield held.iloc[[at]].assign(versions=versions + 1, previous=sha)

    def close(self) -> None:
        pass


def latest_versions(arrivals: DataFrame) -> DataFrame:
    """The last version of each path, of arrivals that are all there; null paths are left out."""
    rest = [c for c in arrivals.columns if c not in ("path", "seq", "sha")]
    last = F.max_by(F.struct("seq", "sha", *rest), F.struct("seq", "sha")).alias("x")
    return arrivals.where("path IS NOT NULL AND sha IS NOT NULL").groupBy("path").agg(last).select("path", "x.*")


def _replace(rows: DataFrame, files: DataFrame, store: str, buckets: int) -> None:
    if read_if_there(rows.sparkSession, store) is None:
        save_results(rows, store, buckets)
    else:
        replace_results(files, rows, store, buckets)


def take_in(changes: DataFrame, store: str, batch_id: str, work: Work, buckets: int = 32) -> None:
    """Saves what path has which content, and the results of contents that have none yet. Doing it
    again changes nothing, wherever it was broken off.

    changes (path, sha, seq, ...), a row for each path; work gets (file_id, ...) with the other
    columns, once for each content."""
    spark, own = changes.sparkSession, [c for c in changes.columns if c not in ("path", "sha", "seq", "versions", "previous")]
    changes = written(changes, "changes")
    if changes.isEmpty():
        return
    names = changes.select(F.lit(batch_id).alias("batch_id"), F.col("path").alias("file_id"), "sha", "seq")
    _replace(names, names, f"{store}/files", buckets)
    held = F.min_by(F.struct(F.lit(0).alias("_"), *own), "path").alias("x")
    contents = changes.groupBy(F.col("sha").alias("file_id")).agg(held).select("file_id", *(F.col("x")[c].alias(c) for c in own))
    if (saved := read_if_there(spark, f"{store}/results")) is not None:
        contents = pending_files(contents, saved.where((F.col("batch_id") == batch_id) & F.col("present")), ["file_id"])
    contents = written(contents, "contents")
    if not contents.isEmpty():
        found = written(work(contents).withColumn("batch_id", F.lit(batch_id)), "found")
        _replace(found, contents.select(F.lit(batch_id).alias("batch_id"), "file_id"), f"{store}/results", buckets)


def intake_stream(arrivals: DataFrame, store: str, checkpoint: str, batch_id: str, work: Work, buckets: int = 32) -> StreamingQuery:
    """Takes in a stream of arrivals (path, sha, seq, ...) until nothing is left of it, and ends; a
    new call with the same checkpoint goes on. Rows with a null path or sha are left out.

    The session's state store must be RocksDB (see ROCKS); the state holds a sha and two numbers a path."""
    spark = arrivals.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in arrivals.schema.fields), _FOUND])
    known = arrivals.where("path IS NOT NULL AND sha IS NOT NULL").withColumn("seq", F.coalesce(F.col("seq").cast("long"), F.lit(0)))
    changed = known.groupBy("path").transformWithStateInPandas(_LastSeen(), schema, "Update", "None")

    def save(batch: DataFrame, number: int) -> None:
        take_in(batch, store, batch_id, work, buckets)

    return changed.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intake_results(spark: SparkSession, store: str, batch_id: str) -> DataFrame:
    """Results of the contents that files have now: path (the smallest that has the content), n_paths,
    sha, and the columns that work gave. Contents that no path has any more don't count."""
    names = saved_results(spark, f"{store}/files").where(F.col("batch_id") == batch_id)
    now = names.groupBy("sha").agg(F.min("file_id").alias("path"), F.count("*").alias("n_paths"))
    own = saved_results(spark, f"{store}/results").where(F.col("batch_id") == batch_id).withColumnRenamed("file_id", "sha")
    return now.join(own, "sha").drop("batch_id")
