"""Progress of a batch while it runs: rows by stage, counted as they are made, and tasks under way."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Count(NamedTuple):
    n_rows: int = 0
    n_files: int = 0
    n_normal: int = 0
    n_review: int = 0


class Progress:
    """Counts of the stages of one batch. A stage's rows are counted in the action that makes them
    (no second pass); `live` tells, from any thread, what that action has done so far. on_change is
    called with the stage and its counts whenever an action of a stage has ended."""

    def __init__(self, spark: SparkSession, on_change: Callable[[str, Count], None] | None = None):
        self._spark, self._on_change, self._lock = spark, on_change, threading.Lock()
        self._counts: dict[str, Count] = {}
        self._running: dict[str, str] = {}

    @contextmanager
    def stage(self, name: str, df: DataFrame, file: str = "file_id", route: str = "route") -> Iterator[DataFrame]:
        """df to be used in exactly one action within the block; a block that fails counts nothing.
        n_files counts files of this action (about, from a million on); without the columns
        it and the routes are 0."""
        seen = Observation()
        files = F.approx_count_distinct(file, 0.01) if file in df.columns else F.lit(0)
        is_ = lambda x: F.count_if(F.col(route) == x) if route in df.columns else F.sum(F.lit(0))
        watched = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), (files if file in df.columns else F.sum(F.lit(0))).alias("n_files"), is_("normal").alias("n_normal"), is_("review").alias("n_review"))
        sc, group = self._spark.sparkContext, f"{name}-{id(seen)}"
        before = sc.getLocalProperty("spark.jobGroup.id")
        sc.setLocalProperty("spark.jobGroup.id", group)
        with self._lock:
            self._running[name] = group
        try:
            yield watched
        finally:
            sc.setLocalProperty("spark.jobGroup.id", before)
            with self._lock:
                del self._running[name]
        got = Count(**{k: v or 0 for k, v in seen.get.items()})
        with self._lock:
            self._counts[name] = total = Count(*(a + b for a, b in zip(self._counts.get(name, Count()), got, strict=True)))
        if self._on_change:
            self._on_change(name, total)

    def counts(self) -> dict[str, Count]:
        """By stage, over all its actions that have ended."""
        with self._lock:
            return dict(self._counts)

    def live(self) -> dict[str, tuple[int, int]]:
        """(tasks done, tasks known) of each stage whose action is under way."""
        tracker = self._spark.sparkContext.statusTracker()
        with self._lock:
            running = dict(self._running)
        out = {}
        for name, group in running.items():
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
            stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
            out[name] = (sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s))
        return out
