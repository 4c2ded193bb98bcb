"""License templates of any length against a comparison of every block, and none at all."""

import random

import pytest

from ledgerloom.llm.license_scan import license_matches


def words(text):
    out = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).split()
    return ["".join(c.lower() if c < "\x80" else c for c in w) for w in out]


def plain(text, notices, threshold, stride):
    found, best, w = set(), 0.0, words(text)
    for notice, label in notices.items():
        t = set(notice.split())
        step = stride
        while step < len(notice.split()):
            step *= 2
        shares = [len(t & set(w[b : b + 2 * step])) / len(t) for b in range(0, len(w), step)]
        if shares and max(shares) >= threshold - 1e-12:
            found.add(label)
            best = max(best, max(shares))
    return sorted(found), best


@pytest.mark.parametrize("stride", [4, 64])
def test_long_templates_equal_a_search_of_every_block(spark, stride):
    rng = random.Random(stride)
    vocabulary = [f"w{i}" for i in range(120)]
    notices = {" ".join(rng.choice(vocabulary) for _ in range(n)): f"l{n}" for n in (3, 4, 5, 9, 30, 70, 300)}
    texts = [None, "", "!"]
    for _ in range(60):
        text = [rng.choice([*vocabulary, "other", "Words"]) for _ in range(rng.randrange(60))]
        for notice in rng.sample(list(notices), 2):
            own = notice.split()
            text += [x for x in own if rng.random() > rng.choice([0, 0.1, 0.3])] + ["more"] * rng.randrange(40)
        texts.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_matches(df, {"w1 w2": "p"}, notices, 0.8, stride).collect()}
    assert len(got) == len(texts)
    n = 0
    for i, text in enumerate(texts):
        found, best = plain(text, notices, 0.8, stride)
        w = words(text)
        places = [k for k in range(len(w) - 1) if w[k : k + 2] == ["w1", "w2"]]
        assert list(got[i].found) == found and [p.start for p in got[i].places] == places and got[i].n_words == len(w)
        assert got[i].best == pytest.approx(max(best, 1.0 if places else 0))
        n += "l300" in found
    assert n >= 3


def test_no_templates(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for phrases, notices in (({}, {}), ({" ": "x"}, {"": "y"})):
        got = {r.doc_id: (r.n_words, r.places, r.found, r.best) for r in license_matches(df, phrases, notices).collect()}
        assert got == {1: (2, [], [], 0.0), 2: (0, [], [], 0.0)}
    only = license_matches(df, {}, {"some words here": "z"}, 0.6).collect()
    assert {r.doc_id: list(r.found) for r in only} == {1: ["z"], 2: []}
    with pytest.raises(ValueError, match="too long"):
        license_matches(df, {"a " * 65: "x"})
