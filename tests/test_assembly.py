"""Assembly of documents against a plain search, and the cases that it is for."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.assembly import assemble, components, document_conflicts, entries_of, overlap_links, retry_units, unit_targets

SCHEMA = "file_id string, start long, stop long, field string, value string, no string, ref string"


def found(spark, *rows):
    return spark.createDataFrame([(*r, None) if len(r) == 6 else r for r in rows], SCHEMA)


def groups(pairs):
    """Node: the smallest node that pairs reach."""
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_equal_a_plain_search(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (60, 80), (200, 120), (1, 1)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        df = spark.createDataFrame([*pairs, (None, 3), (5, None)], "a int, b int")
        assert {r.id: r.component for r in components(df).collect()} == groups(pairs)
    chain = [(i, i + 1) for i in range(300)]
    rng.shuffle(chain)
    assert set(r.component for r in components(spark.createDataFrame(chain, "a int, b int")).collect()) == {0}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("cell", [1, 7, 10_000])
def test_ranges_that_overlap_are_linked(spark, cell):
    rng = random.Random(cell)
    rows = [(rng.choice(["f", "g", None]), s := rng.randrange(150), s + rng.choice([0, 1, 2, 5, 20]), i) for i in range(120)]
    rows += [(f, a, b, i + 1000) for f, a, b, i in rows[:30]]  # equal ranges
    links = [(r.a, r.b) for r in overlap_links(spark.createDataFrame(rows, "f string, s int, e int, id int"), ["f"], "s", "e", "id", cell).collect()]
    whole = [(i, max(i, j)) for f, a, b, i in rows for g, c, d, j in rows if f == g and a < max(d, c + 1) and c < max(b, a + 1)]
    got = groups(links + [(r[3], r[3]) for r in rows])
    assert got == groups(whole)


def test_what_an_overlap_shows_twice_counts_once(spark):
    rows = found(
        spark,
        ("f", 100, 120, "debit", "5.00", "V1"), ("f", 100, 120, "debit", "5.00", "V1"),  # read in two fragments
        ("f", 105, 121, "debit", "5.00", "V1"),  # and once more, a little to the right
        ("f", 300, 320, "debit", "5.00", "V1"),  # an equal entry further on
        ("f", 300, 320, "credit", "9.00", "V1"), ("f", 310, 320, "credit", "9.90", "V1"),  # one place, two values
        ("f", 500, 510, "debit", "5.00", "V2"),
    )
    out = entries_of(assemble(rows, ["no"])).collect()
    assert sorted((r.field, r.start, r.stop, list(r["values"]), r.n_met, r.conflict) for r in out) == [
        ("credit", 300, 320, ["9.00", "9.90"], 2, True), ("debit", 100, 121, ["5.00"], 2, False),
        ("debit", 300, 320, ["5.00"], 1, False), ("debit", 500, 510, ["5.00"], 1, False),
    ]
    assert len({r.document for r in out}) == 2


def test_a_document_over_pages_keys_and_files(spark):
    rows = found(
        spark,
        ("a", 0, 10, "name", "x", "C1", None), ("a", 90, 99, "total", "5", None, "R7"),
        ("a", 40, 50, "party", "p", "C1", "R7"),  # both keys: what they name is one contract
        ("b", 0, 10, "total", "6", None, "R7"), ("b", 60, 70, "name", "y", "C9", None),
        ("c", 0, 9, "name", "z", "C2", None),
    )
    alone = assemble(rows, ["no", "ref"]).groupBy("document").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
    assert sorted(r.v for r in alone) == [["5", "p", "x"], ["6"], ["y"], ["z"]]
    across = assemble(rows, ["no", "ref"], across_files=True)
    assert sorted(r.v for r in across.groupBy("document").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()) == [["5", "6", "p", "x"], ["y"], ["z"]]
    bad = document_conflicts(across, ["total", "name"]).collect()
    assert [(r.field, list(r["values"])) for r in bad] == [("total", ["5", "6"])]
    assert {r.file_id: r.unit for r in retry_units(across).collect()} == {"a": "a", "b": "a", "c": "c"}
    targets = unit_targets(across, spark.createDataFrame([("b",), ("b",)], "file_id string")).collect()
    assert sorted(r.file_id for r in targets) == ["a", "b"]


def test_keyless_candidates_join_the_document_they_overlap(spark):
    rows = found(
        spark,
        ("f", 0, 50, "head", "1", "V1"), ("f", 60, 99, "head", "2", "V2"),
        ("f", 40, 55, "debit", "a", None), ("f", 52, 58, "credit", "b", None),  # a chain that reaches V1
        ("f", 98, 120, "debit", "c", None), ("f", 110, 130, "debit", "c", None),
        ("f", 200, 210, "debit", "d", None), ("g", 0, 50, "debit", "e", None),
        ("h", 0, 9, "head", "3", "V3"), ("h", 8, 20, "head", "4", "V4"), ("h", 8, 9, "debit", "f", None),
    )
    out = {r.value: r for r in assemble(rows, ["no"], cell=10).where("field <> 'x'").collect()}
    assert out["a"].document == out["b"].document == out["1"].document and out["c"].document == out["2"].document
    assert all(out[x].keyed and out[x].reason is None for x in "abc12")
    assert {x: out[x].reason for x in "def"} == {"d": "no business key", "e": "no business key", "f": "overlaps several documents"}
    assert len({out[x].document for x in "def1234"}) == 7


def test_odd_candidates(spark):
    rows = spark.createDataFrame(
        [(None, None, None, None, None, None, "d"), (None, 0, 0, "x", "1", "k", "d"), ("f", 5, 2, "x", "1", "", "e"), ("f", 5, 2, "x", "1", "", "e"), ("f", -7, -3, "x", None, "", "e")],
        "file_id string, start long, stop long, field string, value string, no string, document string",
    )
    out = assemble(rows, ["no"])
    assert out.count() == 4 and out.select("document").distinct().count() == 2  # the keyless row overlaps the one with a key
    entries = {(r.field, r.start): (list(r["values"]), r.conflict) for r in entries_of(out).collect()}
    assert entries[("x", -7)] == ([], None) and entries[("x", 5)] == (["1"], False)
    assert assemble(rows.limit(0), ["no"]).count() == 0
    with pytest.raises(ValueError):
        assemble(rows, [])


def test_a_hot_key_makes_no_pairs(spark):
    rows = spark.range(3000).select(F.lit("f").alias("file_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("stop"), F.lit("x").alias("field"), F.col("id").cast("string").alias("value"), F.lit("K").alias("no"))
    out = assemble(rows, ["no"])
    assert out.select("document").distinct().count() == 1 and out.select("entry").distinct().count() == 3000
