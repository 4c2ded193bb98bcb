"""Nearest-neighbour votes against a plain search, and the space against an exact decomposition."""

import math

import numpy as np
import pytest

from ledgerloom.llm.quality_knn import _CLASS, DIMS, leading_space, score_quality

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    out, raw = [0] * DIMS, [int(c) for c in _CLASS[np.frombuffer((text or "").encode(), np.uint8)]]
    for a, b in zip(raw, raw[1:], strict=False):
        code = (a * 2654435761 % 2**32 + b * (40503 * 2246822519 % 2**32) % 2**32) % 2**32
        out[(code >> 7) % DIMS] += 1
    return out


def plain_vector(counts, idf, text):
    x = [math.log1p(c) * w for c, w in zip(counts, idf, strict=True)]
    n = max(math.sqrt(sum(v * v for v in x)), 1e-12)
    words = (text or "").split()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1)
    x = [v / n for v in x] + [2 * same]
    n = max(math.sqrt(sum(v * v for v in x)), 1e-12)
    return [v / n for v in x]


def test_votes_equal_a_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(90).collect()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs] + [(10**6, None), (10**6 + 1, "x")]
    got = {r.doc_id: r.score for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), neighbours=7, dims=16).collect()}
    counts = {i: plain_counts(t) for i, t in rows}
    df = [sum(c[k] > 0 for c in counts.values()) for k in range(DIMS)]
    idf = [math.log((1 + len(rows)) / (1 + n)) + 1 for n in df]
    text, y = dict(rows), dict(labels)
    known = sorted(i for i in y if i in text)
    vectors = {i: plain_vector(counts[i], idf, text[i]) for i in text}
    space = leading_space(np.array([vectors[i] for i in known], np.float32), 16)

    def unit(i):
        z = np.array(vectors[i]) @ space
        return z / max(np.linalg.norm(z), 1e-12)

    held = {i: unit(i) for i in known}
    mean = sum(y[i] for i in known) / len(known)
    for i in text:
        if not any(counts[i]):
            assert got[i] == pytest.approx(mean, abs=1e-5)
            continue
        z = unit(i)
        near = sorted(known, key=lambda k: -float(z @ held[k]))[:7]
        weight = [max(float(z @ held[k]), 0) ** 8 + 1e-6 for k in near]
        assert got[i] == pytest.approx(sum(w * y[k] for w, k in zip(weight, near, strict=True)) / sum(weight), abs=2e-3)


def test_the_space_is_that_of_the_leading_singular_vectors():
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((120, 40)) * (0.8 ** np.arange(40))) @ np.linalg.qr(rng.standard_normal((300, 40)))[0].T
    space = leading_space(x.astype(np.float32), 8)
    exact = np.linalg.svd(x, full_matrices=False)[1][:8]
    assert np.allclose(space.T @ space, np.eye(8), atol=1e-4)
    assert np.linalg.norm(x @ space) == pytest.approx(np.linalg.norm(exact), rel=1e-3)
