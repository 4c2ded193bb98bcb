"""Packing, context and numbering of rows in order, part by part."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions.fragments import neighbour_context, pack_blocks
from ledgerloom.functions.packing import fold, fragments, packed, summary
from ledgerloom.functions.positions import given_back, placed
from ledgerloom.operators.batches import row_positions


def plain(files, sizes, most):
    out, at = [], object()
    for f, n in zip(files, sizes, strict=True):
        if f != at:
            at, frag, used = f, 0, 0
        elif used and used + n > most:
            frag, used = frag + 1, 0
        used += n
        out.append(frag)
    return out


def test_parts_packed_one_by_one_equal_one_sweep():
    rng = random.Random(1)
    for _ in range(1500):
        n, most = rng.randrange(1, 40), rng.choice([1, 3, 10, 30])
        files = np.array(sorted(rng.choice(range(rng.choice([1, 2, 5, 20]))) for _ in range(n)))
        sizes = np.array([rng.choice([0, 0, 1, 2, 5, rng.randrange(40)]) for _ in range(n)])
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(rng.randrange(6)))})
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        told = [(p, *r) for p, (a, b) in enumerate(parts) for r in summary(files[a:b], sizes[a:b], most)]
        begun = {p: x for p, *x in fold(iter(told))}
        got = [f for p, (a, b) in enumerate(parts) for f in fragments(files[a:b], sizes[a:b], most, *begun[p]).tolist()]
        assert got == plain(files.tolist(), sizes.tolist(), most)


def test_a_file_of_a_million_blocks_is_packed_by_all_tasks(spark):
    """Its places lie in many parts of like size, and no text goes there."""
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("f").alias("f"), F.col("id").alias("b"), F.repeat(F.lit("x"), (F.xxhash64("id") % 50 + 50).cast("int")).alias("text"))
    began = time.time()
    places = placed(df, ["f", "b"], 12, n=F.length("text").cast("long"))
    assert set(places.columns) == {"k0", "k1", "h", "occ", "n", "part"}
    held = [r["count"] for r in places.groupBy("part").count().collect()]
    assert len(held) == 12 and max(held) < 2 * min(held)
    out = packed(places, 1500).select("k1", "frag_no").toPandas().sort_values("k1")
    sizes = df.select("b", F.length("text").alias("n")).toPandas().sort_values("b").n.tolist()
    assert out.frag_no.tolist() == plain(["f"] * len(sizes), sizes, 1500)
    assert time.time() - began < 300


def made(spark, rng, n):
    rows = [(rng.choice(["f", "f", "f", "g", "h", None]), rng.choice([rng.randrange(60), None]), rng.choice(["", None, "abc", "x" * rng.randrange(30)]), "n", {"m": 1}) for _ in range(n)]
    rows += rows[: n // 3]  # repeated rows
    return spark.createDataFrame(rows, "k0 string, h int, text string, frag_no string, part map<string,int>").repartition(5)


def test_repeated_and_odd_blocks_stay_as_many_as_they_are(spark):
    df = made(spark, random.Random(2), 150)
    out = pack_blocks(df, "k0", "h", "text", 20)
    assert out.columns == ["k0", "h", "text", "part", "frag_no"] and out.count() == df.count()
    rows = out.collect()
    assert Counter((r.k0, r.h, r.text) for r in rows) == Counter((r.k0, r.h, r.text) for r in df.collect())
    held = defaultdict(list)
    for r in rows:
        held[r.k0, r.frag_no].append(r)
    for (f, k), own in held.items():
        assert sum(len(r.text or "") for r in own) <= 20 or sum(bool(r.text) for r in own) == 1
        # blocks are in order over the fragments of a file
        after = [r.h for x in held if x[0] == f and x[1] > k for r in held[x]]
        assert all((-1 if a.h is None else a.h) <= (-1 if b is None else b) for a in own for b in after)
    for f in {r.k0 for r in rows}:
        assert {r.frag_no for r in rows if r.k0 == f} == set(range(1 + max(r.frag_no for r in rows if r.k0 == f)))
    assert pack_blocks(df.limit(0), "k0", "h", "text", 20).count() == 0


def test_context_over_the_borders_of_parts(spark):
    n = 3000
    df = spark.range(n).select(F.when(F.col("id") < 2500, "f").otherwise("g").alias("head"), F.col("id").alias("tail"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" end")).alias("before")).repartition(7)
    out = neighbour_context(df.withColumn("after", F.lit(1)), "head", "tail", "before", 9).drop("after")
    assert out.columns == ["head", "tail", "before"]  # before was the text, and is the context now
    df = df.withColumnRenamed("before", "text")
    got = {r.tail: (r.before, r.after) for r in neighbour_context(df, "head", "tail", "text", 9).collect()}
    text = [f"text {i} end" for i in range(n)]
    border = {0, 2500, n}
    assert got == {i: (None if i in border else text[i - 1][-9:], None if i + 1 in border else text[i + 1][:9]) for i in range(n)}


def test_context_of_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([("f", 1, "a"), ("f", 1, "a"), ("f", 2, None), ("f", 3, "c"), (None, 1, "d"), (None, 2, "e"), ("g", 1, "")], "f string, o int, text string")
    got = sorted((str(r.f), r.o, str(r.before), str(r.after)) for r in neighbour_context(df, "f", "o", "text", 5).collect())
    assert got == [
        ("None", 1, "None", "e"), ("None", 2, "d", "None"), ("f", 1, "None", "a"), ("f", 1, "a", "None"),
        ("f", 2, "a", "c"), ("f", 3, "None", "None"), ("g", 1, "None", "None"),
    ]
    assert neighbour_context(df.limit(0), "f", "o", "text", 5).count() == 0


def test_numbers_with_clashing_names_and_ties(spark):
    df = spark.createDataFrame([(i % 7, i % 3, "x", 1, 2, 3) for i in range(200)], "k0 int, _p int, h string, _n int, _rn int, row_no int").repartition(6)
    out = row_positions(df, ["k0"], start=5)
    assert out.columns == ["k0", "_p", "h", "_n", "_rn", "row_no"]
    rows = sorted(out.collect(), key=lambda r: r.row_no)
    assert [r.row_no for r in rows] == list(range(5, 205)) and [r.k0 for r in rows] == sorted(r.k0 for r in rows)
    assert Counter((r.k0, r._p) for r in rows) == Counter((i % 7, i % 3) for i in range(200))


def test_what_was_found_goes_back_to_each_row(spark):
    df = made(spark, random.Random(9), 60)
    places = placed(df, ["k0"])
    out = given_back(df, ["k0"], places.withColumn("x", F.col("occ")), ["x"])
    assert out.count() == df.count()
    assert Counter((r.k0, r.h, r.text, r.x) for r in out.collect()) == Counter((k, h, t, i + 1) for (k, h, t), m in Counter((r.k0, r.h, r.text) for r in df.collect()).items() for i in range(m))
