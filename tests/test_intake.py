"""Intake as a stream leaves the store that one batch run leaves."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming.intake import _LastSeen, ROCKS, intake_results, intake_stream, latest_versions, take_in

SCHEMA = "path string, sha string, seq long, text string"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def arrive(spark, at, *rows):
    spark.createDataFrame([(p, t and f"sha of {t}", s, t) for p, s, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")


def run(spark, at, work):
    arrivals = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    intake_stream(arrivals, f"{at}/store", f"{at}/mark", "b", work, 4).awaitTermination()


def counting(spark):
    asked = spark.sparkContext.accumulator(0)

    def work(contents):
        asked.add(contents.count())
        # two rows for a text, so that replacing them shows
        return contents.select("file_id", F.upper("text").alias("found"), F.explode(F.array(F.lit(1), F.lit(2))).alias("line"))

    return work, asked


def view(spark, store):
    return sorted(map(tuple, intake_results(spark, store, "b").select("path", "n_paths", "sha", "found", "line").collect()))


def same_as_one_batch(spark, at, work):
    take_in(latest_versions(spark.read.schema(SCHEMA).parquet(f"{at}/in")), f"{at}/batch", "b", work, 4)
    got = view(spark, f"{at}/store")
    assert got == view(spark, f"{at}/batch")
    return got


def test_new_names_changes_and_late_versions(spark, tmp_path):
    work, asked = counting(spark)
    at = f"file://{tmp_path}"
    arrive(spark, at, ("m", 1, "one"), ("n", 1, "two"), (None, 1, "x"), ("q", 1, None))
    run(spark, at, work)
    assert asked.value == 2
    arrive(spark, at, ("a", 2, "one"), ("m", 1, "one"))  # the same content under a smaller name, and nothing new
    run(spark, at, work)
    assert asked.value == 2
    arrive(spark, at, ("n", 5, "three"))  # a changed file
    arrive(spark, at, ("n", 4, "four"), ("z", 1, "three"))  # an older version that comes late
    run(spark, at, work)
    run(spark, at, work)
    assert asked.value == 3  # nothing again, and "four" was never the last
    got = same_as_one_batch(spark, at, work)
    assert [(p, n, f) for p, n, _, f, line in got if line == 1] == [("a", 2, "ONE"), ("n", 2, "THREE")]


def test_a_restart_in_the_middle_of_a_batch(spark, tmp_path):
    work, asked = counting(spark)
    at, broken = f"file://{tmp_path}", [True]

    def breaks(contents):
        if broken[0]:
            raise RuntimeError("lost")
        return work(contents)

    arrive(spark, at, ("a", 1, "one"), ("b", 1, "two"))
    with pytest.raises(Exception, match="lost"):
        run(spark, at, breaks)
    # by then the names were saved, the results were not
    assert spark.read.parquet(f"{at}/store/files").count() == 2
    arrive(spark, at, ("b", 2, "one"))
    broken[0] = False
    run(spark, at, breaks)
    got = same_as_one_batch(spark, at, work)
    assert [(p, n, f) for p, n, _, f, line in got if line == 1] == [("a", 2, "ONE")]


def test_any_order_of_arrival_ends_alike(spark, tmp_path):
    rng = random.Random(3)
    work, asked = counting(spark)
    at = f"file://{tmp_path}"
    rows = [(f"p{rng.randrange(12)}", rng.randrange(6), f"t{rng.randrange(8)}") for _ in range(60)]
    for i in range(0, 60, 20):
        arrive(spark, at, *rows[i : i + 20])
        run(spark, at, work)
    assert asked.value <= 8
    assert same_as_one_batch(spark, at, work)


def test_another_state_store_is_refused(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    spark.range(1).selectExpr("'a' path", "'s' sha", "id seq", "'t' text").write.parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="providerClass"):
        intake_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "x", "y", "b", lambda x: x)


def test_a_path_asks_its_state_once_and_makes_frames_only_of_what_is_new():
    class State:  # with no more than the calls that a path needs
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.held = value

    seen = _LastSeen()
    seen.seen = state = State()

    def take(*parts):
        frames = [pd.DataFrame(rows, columns=["path", "sha", "seq"]) for rows in parts]
        return [tuple(r) for f in seen.handleInputRows(("p",), iter(frames), None) for r in f.itertuples(index=False)]

    assert take([("p", "a", 1), ("p", "c", 4), ("p", "b", 4)], [("p", "z", 3)]) == [("p", "c", 4, 1, None)]
    assert take([("p", "b", 4)]) == [] and state.held == ("c", 4, 1)  # late
    assert take([("p", "c", 5)]) == [] and state.held == ("c", 5, 1)  # the same content
    assert take([("p", "a", 2)], [("p", "d", 6)]) == [("p", "d", 6, 2, "c")]
    assert state.calls == 4
