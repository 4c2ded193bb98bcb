"""Languages of few documents are judged as well."""

import math
import random

from ledgerloom.llm import queries
from ledgerloom.llm.quality_rules import SPREAD, judged


def test_small_languages_have_bands(spark):
    """Logarithms of perplexity; a base failure and a text without one count for nothing."""
    logs = {"big": [9 + i / 100 for i in range(60)] + [20.0], "a": [10.0, 10.5, 11, 11.5, 12, 30], "b": [10.0, 10.1, 22], "c": [35.0], "d": [10.0, 11], None: [8.0, 9, 10, 40]}
    rows = [(lang, False, math.exp(x)) for lang, own in logs.items() for x in own] + [("a", True, 1.0), ("e", True, 5.0), ("b", False, None)]
    df = spark.createDataFrame(rows, "lang string, base_failed boolean, ppl double")
    out = judged(df, small=True).collect()
    assert len(out) == len(rows)
    dropped = sorted((r.lang or "", round(math.log(r.ppl))) for r in out if not r.kept and not r.base_failed)
    assert dropped == [("", 40), ("a", 30), ("b", 22), ("big", 20)]
    # of each language: median, distance of its quartile, documents
    apart = {}
    for lang, own in logs.items():
        v = sorted(own)
        apart[lang] = (v[math.ceil(len(v) / 2) - 1], v[math.ceil(len(v) / 2) - 1] - v[math.ceil(len(v) / 4) - 1], len(v))
    few = [x for lang, x in apart.items() if lang != "big"]
    mean = sum(d * n for _, d, n in few) / sum(n for *_, n in few)
    for r in out:
        if r.lang == "e":
            assert r.ppl_low is None
            continue
        median, d, _ = apart[r.lang]
        d = d if r.lang == "big" else max(d, mean, SPREAD)
        assert math.isclose(r.ppl_high, math.exp(median + 12 * d + 0.05), rel_tol=1e-9) and math.isclose(r.ppl_low, math.exp(median - 12 * d - 0.05), rel_tol=1e-9)
    without = judged(df).collect()
    assert all(r.kept == (not r.base_failed) for r in without if r.lang != "big")


def test_the_query_judges_a_language_of_few_documents(spark, tmp_path):
    """Twelve German texts are the language; letters at random among them are found."""
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    texts = [r.text for r in docs.join(good, "doc_id").where("lang = 'de' AND n_chars BETWEEN 1000 AND 4000").orderBy("doc_id").limit(12).collect()]
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200)) for _ in range(2)]
    rows = [(i, t, "de") for i, t in enumerate(texts + junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op10_quality_rules(spark, str(tmp_path)).collect()}
    assert not any(out[i].base_failed for i in range(14))
    assert [i for i in range(14) if not out[i].kept] == [12, 13]
