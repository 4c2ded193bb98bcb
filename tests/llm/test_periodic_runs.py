"""Periodic runs against a search of every period, and odd inputs."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.periodic_runs import overlap_k, periodic_runs, runs_between, surviving
from ledgerloom.llm.queries import _CRC_TABLE, _crc_sql, rewritten
from ledgerloom.llm.textcore import words_of


def plain_runs(words, least, times):
    """Every period compared at every word."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    words = []
    for _ in range(rng.randrange(8)):
        words += [rng.choice("abcd") for _ in range(rng.randrange(6))]
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 5))]
        words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
    return words


@pytest.mark.parametrize("least,times", [(6, 4), (2, 4), (8, 5), (9, 4)])
def test_runs_equal_a_search_of_every_period(least, times):
    rng = random.Random(least)
    for _ in range(150):
        texts = [" ".join(made(rng)) if rng.random() > 0.05 else None for _ in range(rng.randrange(1, 6))]
        w = words_of(pa.array(texts, pa.string()))
        runs = runs_between(w.hash, *surviving(w, overlap_k(least, times), least), least, times)
        doc = w.doc()[runs.start]
        for i, text in enumerate(texts):
            own = doc == i
            got = list(zip((runs.start - w.first[doc])[own].tolist(), (runs.end - runs.start)[own].tolist(), runs.period[own].tolist(), strict=True))
            assert got == plain_runs((text or "").split(), least, times)


def test_every_gram_of_a_run_stands_twice_in_it():
    for least in range(2, 30):
        for times in (4, 5, 7):
            k = overlap_k(least, times)
            for q in range(1, 12):
                for n in range(max(least, times * q), max(least, times * q) + 3):
                    word = np.arange(n) % q
                    grams = [tuple(word[i : i + k]) for i in range(n - k + 1)]
                    assert all(grams.count(g) > 1 for g in grams)


def test_table_of_odd_rows(spark):
    long = " ".join([*(f"w{i}" for i in range(20000)), *["x", "y"] * 5000])
    rows = [(1, None), (None, "a b c"), (2, ""), (3, " \n\t"), (4, long), (5, "é é é é é é"), (5, "é é é é é é"), (6, "a a a a a"), (7, "a\na\ta a  a a b")]
    df = spark.createDataFrame([(i, t, "r", "n", 1) for i, t in rows], "doc_id long, text string, row string, runs string, start int")
    out = periodic_runs(df).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.text): r for r in out}
    assert all(r.row == "r" and r.start == 1 for r in out)
    for text in (None, "", " \n\t"):
        r = next(r for r in out if r.text == text)
        assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
    assert [tuple(x) for x in by[4, long].runs] == [(20000, 10000, 2)] and by[4, long].collapsed == " ".join([*(f"w{i}" for i in range(20000)), "x", "y"])
    assert [tuple(x) for x in by[5, "é é é é é é"].runs] == [(0, 6, 1)] and by[5, "é é é é é é"].collapsed == "é"
    assert by[6, "a a a a a"].runs == [] and by[7, "a\na\ta a  a a b"].collapsed == "a b"
    assert periodic_runs(df.limit(0)).count() == 0


def test_rewritten_texts_and_their_runs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(made(rng)) if rng.random() > 0.1 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs(df.withColumn("text", rewritten(F.col("doc_id"), F.col("text")))).collect()}
    crc = spark.range(300).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("h")).collect()
    for (i, text), h in zip(rows, [r.h for r in sorted(crc)], strict=True):
        words = (text or "").split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = plain_runs(words, 6, 4)
        assert [tuple(x) for x in got[i].runs] == runs and got[i].collapsed == collapsed(words, runs) and got[i].n_words == n


def test_sql_of_crc32():
    import zlib

    words = ["", "1", "äbc", "12:word"]
    sql = f"WITH RECURSIVE {_CRC_TABLE} SELECT word, {_crc_sql('h')} AS c FROM (SELECT word, hex(encode(word)) AS h FROM v), crc"
    con = duckdb.connect()
    con.register("v", pd.DataFrame({"word": words}))
    assert dict(con.sql(sql).fetchall()) == {w: zlib.crc32(w.encode()) for w in words}
