"""Differences between tables, sheets, and the export job."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.jobs.export import export_job
from ledgerloom.operators.sheets import cut_sheets
from ledgerloom.sources.difference import differences, unequal_branches
from ledgerloom.sources.store import latest_export, write_ledger


def test_one_changed_row_of_many_is_named(spark, tmp_path):
    a = spark.range(0, 600_000, 1, 8).select("id", (F.col("id") * 7 % 1000).cast("string").alias("v"), F.when(F.col("id") % 3 == 0, "x").alias("w"))
    a.write.parquet(f"{tmp_path}/a")
    a.withColumn("v", F.when(F.col("id") == 123_456, "other").otherwise(F.col("v"))).select("w", "v", "id").write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    found = differences(a, b, ["id"])
    assert sorted(map(tuple, found.collect())) == [("actual", 1, 123_456, "other", "x"), ("expected", 1, 123_456, str(123_456 * 7 % 1000), "x")]
    bits, bad = unequal_branches(a, b, ["id"])
    assert len(bad) == 1 and 600_000 >> bits < 1000  # one branch of some ten rows is shuffled
    assert len(unequal_branches(a, b)[1]) == 2  # without keys both forms lie in branches of their own
    assert unequal_branches(a, a.repartition(3)) == (0, []) and differences(a, a).count() == 0


def test_differences_equal_a_comparison_of_counts(spark):
    rng = random.Random(1)
    for n, leaf in ((0, 1), (40, 1), (3000, 2), (3000, 1000)):
        a = [(rng.randrange(n), rng.choice(["a", "b", None, ""])) for _ in range(n)]
        b = [x for x in a if rng.random() > 0.1] + [(rng.randrange(n), "z") for _ in range(n // 50)] + [(5, None)] * 3
        left, right = (spark.createDataFrame(x, "k int, v string") for x in (a, b))
        x, y = Counter(a), Counter(b)
        for keys in (None, ["k"]):
            got = {(r.side, r.k, r.v): r.times for r in differences(left, right, keys, leaf).collect()}
            assert got == {("expected", *k): v for k, v in (x - y).items()} | {("actual", *k): v for k, v in (y - x).items()}
    with pytest.raises(ValueError, match="columns"):
        differences(left, left.withColumnRenamed("v", "w"))


def test_a_ledger_is_made_once_when_it_is_written(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(500).mapInPandas(count, "id long")
    paths = write_ledger(rows, rows.limit(0), f"file://{tmp_path}/out", "1")
    assert made.value == 500 and spark.read.parquet(paths[0]).count() == 500 and spark.read.parquet(f"{tmp_path}/out/finished").first().n_normal == 500


def plain_sheets(rows, most):
    """rows (voucher, at): sheets of whole vouchers, in order."""
    first = {}
    for v, at in rows:
        first[v] = min(first.get(v, at), at)
    sheets, used = [[]], 0
    for v in sorted(first, key=lambda v: (first[v], f"k{v}")):
        own = sorted(at for x, at in rows if x == v)
        if used and used + len(own) > most:
            sheets.append([])
            used = 0
        sheets[-1] += [(v, at) for at in own]
        used += len(own)
    return [(s, i, v, at) for s, own in enumerate(sheets, 1) for i, (v, at) in enumerate(own)]


def test_sheets_hold_whole_vouchers(spark):
    rng = random.Random(4)
    rows = [(f"V{rng.randrange(40)}", at) for at in rng.sample(range(10_000), 300)]
    most = max(Counter(v for v, _ in rows).values()) + 5
    df = spark.createDataFrame([(v, at, "x", "y", 0) for v, at in rows], "v string, at int, h string, n string, sheet_no int").repartition(5)
    out = cut_sheets(df, "v", ["at"], most, start=3)
    assert out.columns == ["v", "at", "h", "n", "sheet_no", "row_no"]
    assert sorted((r.sheet_no, r.row_no - 3, r.v, r["at"]) for r in out.collect()) == plain_sheets(rows, most)
    with pytest.raises(ValueError, match="more than 3 rows"):
        cut_sheets(df, "v", ["at"], 3)
    keyless = spark.createDataFrame([(None, i) for i in range(10)], "v string, at int")
    assert sorted((r.sheet_no, r.row_no, r["at"]) for r in cut_sheets(keyless, "v", ["at"], 4).collect()) == [(i // 4 + 1, i % 4 + 1, i) for i in range(10)]
    assert cut_sheets(df.limit(0), "v", ["at"], 5).count() == 0


def ledger(spark, n, text="t"):
    rows = [(f"V{i // 3}", i, {"name": f"n{i}", "total": str(i), "more": text}, f"file{i % 2}", f"paragraph {i}") for i in range(n)]
    return spark.createDataFrame(rows, "v string, at int, fields map<string,string>, source_file string, source_position string")


def test_an_export_is_written_whole_or_not_at_all(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    job = lambda run, normal, **how: export_job(normal, ledger(spark, 2), ["name", None, "total"], "v", ["at"], out, run, **{"most": 7} | how)
    job("1", ledger(spark, 20))
    rows = latest_export(spark, out).drop("run_id").orderBy("sheet_no", "row_no").collect()
    assert rows[0].asDict() == {"sheet_no": 1, "row_no": 2, "name": "n0", "gap_2": None, "total": "0", "source_file": "file0", "source_position": "paragraph 0"}
    assert [(r.sheet_no, r.row_no, r.name) for r in rows] == [(i // 6 + 1, i % 6 + 2, f"n{i}") for i in range(20)]
    assert latest_export(spark, out, "review").count() == 2
    for what, how in (
        ("headers", {"normal": ledger(spark, 20), "columns": None}), ("more than 2 rows", {"normal": ledger(spark, 20), "most": 2}),
        ("hold something", {"normal": ledger(spark, 20), "existing": spark.createDataFrame([(2, 7), (9, 9)], "sheet_no int, row_no int")}),
        ("can't hold", {"normal": ledger(spark, 20).withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, _: k != "name"), F.create_map(F.lit("name"), F.repeat(F.lit("x"), 40_000))))}),
    ):
        with pytest.raises(ValueError, match=what):
            if how.pop("columns", 1) is None:
                export_job(how["normal"], ledger(spark, 2), ["name", "name"], "v", ["at"], out, "2", 7)
            else:
                job("2", **how)
    free = spark.createDataFrame([(1, 8), (9, 9)], "sheet_no int, row_no int")
    job("2", ledger(spark, 9), existing=free)  # a run that was stopped has left nothing behind
    assert latest_export(spark, out).count() == 9
