"""Components of similar texts against all pairs, at several similarities."""

import random

import pytest

from ledgerloom.llm.jaccard_join import similar_components


@pytest.mark.parametrize("num", [5, 7, 8, 9])
def test_no_link_is_lost(spark, num):
    """Pairs of sets whose similarity lies at or just above the level, of sizes as different as it allows."""
    rng, docs, fresh = random.Random(num), [], iter(range(10**6))
    for i in range(60):
        n = rng.randrange(20, 160)
        base = [f"w{next(fresh)}" for _ in range(n)]
        if i % 2:  # a text and its beginning
            docs += [base, base[: -(-n * num // 10)]]
        else:  # two texts of one size that share a part
            shared = -(-2 * n * num // (10 + num))
            docs += [base, base[:shared] + [f"w{next(fresh)}" for _ in range(n - shared)]]
    sets = [set(d) for d in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert sum(root[i] != i for i in range(len(docs))) == 60
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_components(df, n=1, num=num, den=10).collect()}
    assert got == dict(enumerate(root))
