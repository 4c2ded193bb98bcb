"""Counts by stage, taken while a batch runs."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.jobs.batch import run_batch
from ledgerloom.jobs.progress import Count, Progress
from ledgerloom.operators.batches import batch_summary


def test_counts_equal_those_of_the_batch(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", f"p{i}", str(i)) for i in range(50)], "file_id string, path string, sha string")
    made, told = spark.sparkContext.accumulator(0), []

    def work(df):
        def one(batches):
            for b in batches:
                made.add(len(b))
                yield b

        rows = df.select("file_id").mapInPandas(one, "file_id string")
        number = F.substring("file_id", 2, 9).cast("int")
        return rows.select("file_id", F.explode(F.sequence(F.lit(1), number % 3 + 1)).alias("n"), F.when(number % 5 == 0, "review").otherwise("normal").alias("route"))

    progress = Progress(spark, lambda name, count: told.append((name, count)))
    out = run_batch(spark, f"file://{tmp_path}/store", "b", {"model": "m"}, files, work, 4, progress)
    summary = batch_summary(out, "batch_id").first()
    assert progress.counts() == {"extract": Count(out.count(), 50, summary.n_normal, summary.n_review)}
    assert made.value == 50 and len(told) == 4 and told[-1][1] == progress.counts()["extract"]
    assert [c.n_rows for _, c in told] == sorted(c.n_rows for _, c in told) and progress.live() == {}


def test_tasks_are_seen_while_they_run(spark, tmp_path):
    def slow(batches):
        for b in batches:
            time.sleep(0.3)
            yield b

    progress, seen, over = Progress(spark), [], threading.Event()

    def look():
        while not over.is_set():
            seen.extend(progress.live().items())
            time.sleep(0.05)

    t = threading.Thread(target=look)
    t.start()
    with progress.stage("read", spark.range(0, 24, 1, 12).mapInPandas(slow, "id long")) as df:
        df.write.parquet(f"{tmp_path}/out")
    over.set()
    t.join()
    assert any(name == "read" and 0 < done < known for name, (done, known) in seen)
    assert progress.counts() == {"read": Count(24)}


def test_a_stage_that_fails_counts_nothing(spark):
    progress = Progress(spark)
    with pytest.raises(RuntimeError), progress.stage("read", spark.range(3)):
        raise RuntimeError
    assert progress.counts() == {} and progress.live() == {}
