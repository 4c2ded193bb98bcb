"""Answers that were broken off keep what is whole in them."""

import json

from pyspark.sql import functions as F

from ledgerloom.functions.fields import salvage_response, whole_elements

ITEMS = [{"no": "A{1", "n": 1, "sub": {"x": [1, {"y": 2}]}}, {"no": 'q"]}\\', "n": 2}, {"no": "é", "n": None}, {"no": "last", "n": 4, "list": []}]


def salvaged(spark, answers):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    rows = df.select("i", whole_elements(F.col("a"), "candidates").alias("w"), salvage_response(F.col("a"), "no STRING, n INT", ("no", "n")).alias("s")).orderBy("i").collect()
    return [(r.w, r.s) for r in rows]


def test_of_an_answer_cut_anywhere_all_whole_candidates_stay(spark):
    for whole in (json.dumps(ITEMS), json.dumps({"note": "[{", "candidates": ITEMS, "more": [{"no": "other"}]}, ensure_ascii=False, indent=1)):
        answers = [whole[:k] for k in range(len(whole) + 1)]
        ends, at = [], 0
        decode = json.JSONDecoder().raw_decode
        at = whole.index("[", whole.index("candidates") if whole[0] == "{" else 0) + 1
        for item in ITEMS:
            at = whole.index("{", at)
            got, at = decode(whole, at)
            assert got == item
            ends.append(at)
        close = whole.index("]", ends[-1]) + 1
        begin = whole.index("[", whole.index("candidates")) + 1 if whole[0] == "{" else 1
        for k, (w, s) in enumerate(salvaged(spark, answers)):
            n = sum(e <= k for e in ends)
            if k < begin:
                assert w is None and s.reasons == ["unreadable answer"] and s.candidates == []
                continue
            assert [json.loads(x) for x in w.elements] == ITEMS[:n] and w.ended == (k >= close)
            assert s.reasons == ([] if k >= close else [f"answer broken off after {n} whole candidates"])
            assert [(c.value.no, c.value.n) for c in s.candidates] == [(x["no"], x["n"]) for x in ITEMS[:n]]
            assert [c.reasons for c in s.candidates] == [["missing n"] if x["n"] is None else [] for x in ITEMS[:n]]


def test_odd_answers(spark):
    answers = [None, "", "no", "[]", '{"candidates": []}', '{"other": [{"no": "x"}]}', 'Here: [{"no": "x", "n": 1}] as asked {', '[{"no": x}, {"no": "y", "n": "z"}]', "[1, 2]", '{"candidates": {"no": "x"}}']
    got = salvaged(spark, answers)
    none = ["unreadable answer"]
    assert [s.reasons for _, s in got] == [none, none, none, [], [], none, [], [], [], none]
    assert [len(s.candidates) for _, s in got] == [0, 0, 0, 0, 0, 0, 1, 2, 0, 0]
    assert [c.reasons for c in got[7][1].candidates] == [["unreadable answer"], ["unreadable answer"]]
    assert got[6][1].candidates[0].value.no == "x"


def test_a_long_answer(spark):
    text = json.dumps([{"no": str(i), "n": i} for i in range(2000)])[:-5]
    (_, s), = salvaged(spark, [text])
    assert len(s.candidates) == 1999 and s.reasons == ["answer broken off after 1999 whole candidates"]
