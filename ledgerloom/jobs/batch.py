"""A batch as a job: begun, resumed after a break, and retried for the files under review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import config_fingerprint
from ..operators.batches import pending_files, retry_targets, source_drift
from ..operators.checks import stop_if_any
from ..sources.store import read_if_there, replace_results, save_results, saved_results
from .progress import Progress
from .rounds import ask_rounds, route_answers

Work = Callable[[DataFrame], DataFrame]


def asked_work(store: str, request: Column, call: Callable[[str], str], parse: Work, name: str = "first", max_tries: int = 3, at_once: int = 2) -> Work:
    """Work for run_batch and retry_batch that asks a service about each file, at most at_once
    calls at a time, and writes all attempts to `{store}/asked/{name}`: a batch that is broken
    off, or stopped by a permanent failure, asks nothing twice when it runs again. A retry of files under
    review asks anew under another name. parse gets (file_id, answer) of the files that were
    answered and gives (file_id, ...), a row at least for each; a file that was given up is one row
    under review with its reason (route, reasons; other columns null)."""

    def work(files: DataFrame) -> DataFrame:
        at = f"{store}/asked/{name}"
        said = ask_rounds(files.select("file_id", request.alias("request")), ["file_id"], at, call, "request", max_tries, at_once)
        answers = route_answers(said, ["file_id"], max_tries).join(files.select("file_id"), "file_id", "left_semi")
        rows = parse(answers.where("size(reasons) = 0").select("file_id", "answer"))
        given_up = answers.where("size(reasons) > 0").select("file_id", F.lit("review").alias("route"), F.array_join("reasons", ";").alias("reasons"))
        return rows.unionByName(given_up, allowMissingColumns=True)

    return work


def check_conditions(spark: SparkSession, store: str, config: dict[str, str], files: DataFrame) -> None:
    """The first run writes down what the batch runs under and its sources (path, sha); a later
    one under other conditions, or over changed or missing sources, is refused."""
    now = spark.range(1).select(config_fingerprint(**{k: F.lit(v) for k, v in config.items()}).alias("fingerprint"))
    if (before := read_if_there(spark, f"{store}/config")) is None:
        files.select("path", "sha").write.mode("overwrite").parquet(f"{store}/sources")
        now.write.parquet(f"{store}/config")
        return
    if not before.exceptAll(now).isEmpty():
        raise ValueError("the batch was begun under other conditions")
    drift = source_drift(spark.read.parquet(f"{store}/sources"), files, "path", "sha")
    stop_if_any(drift.where("state IN ('changed', 'missing')"), "sources of the batch are not as they were")


def run_batch(spark: SparkSession, store: str, batch_id: str, config: dict[str, str], files: DataFrame, work: Work, steps: int = 4, progress: Progress | None = None) -> DataFrame:
    """Results of work over all of files (file_id, path, sha): saved ones stay, the others are
    worked on in steps by hash of file_id, each saved as it ends, so a run that was broken off
    goes on with the step it was in. work gives (file_id, ...), a row at least for each file; what
    it gives is counted as stage "extract" of progress."""
    progress = progress or Progress(spark)
    check_conditions(spark, store, config, files)
    for step in range(steps):
        saved = read_if_there(spark, f"{store}/results")
        left = files.where(F.pmod(F.xxhash64("file_id"), F.lit(steps)) == step)
        if saved is not None:
            left = pending_files(left, saved.where((F.col("batch_id") == batch_id) & F.col("present")), ["file_id"])
        if not left.isEmpty():
            with progress.stage("extract", work(left).withColumn("batch_id", F.lit(batch_id))) as found:
                # the buckets of a step are those of no other
                if saved is None:
                    save_results(found, f"{store}/results", steps)
                else:
                    replace_results(left.withColumn("batch_id", F.lit(batch_id)), found, f"{store}/results", steps)
    return saved_results(spark, f"{store}/results").where(F.col("batch_id") == batch_id)


def retry_batch(spark: SparkSession, store: str, batch_id: str, config: dict[str, str], files: DataFrame, work: Work, steps: int = 4) -> DataFrame:
    """The files of which some result is under review are worked on again, and theirs alone are
    replaced (results need a column route)."""
    check_conditions(spark, store, config, files)
    saved = saved_results(spark, f"{store}/results").where(F.col("batch_id") == batch_id)
    again = retry_targets(files, saved.where("route = 'review'"), "file_id").withColumn("batch_id", F.lit(batch_id))
    replace_results(again.select("batch_id", "file_id"), work(again.drop("batch_id")).withColumn("batch_id", F.lit(batch_id)), f"{store}/results", steps)
    return saved_results(spark, f"{store}/results").where(F.col("batch_id") == batch_id)
