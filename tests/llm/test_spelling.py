"""Automata and spelling variants against comparisons of all pairs, and odd inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerloom.llm.automata import Automaton, Letters
from ledgerloom.llm.spelling import crc32_after, latin_words, near_words, numbered, roots, spelling_forms


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x.encode()), default=None)
        out[w] = [best if best is not None and counts[best] >= ratio * n else None, n, len(others)]
    for w, x in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        x += [root, counts[x[0]] if x[0] is not None else None]
    return {w: (form, root, n, n_near, form_n) for w, (form, n, n_near, root, form_n) in out.items()}


def test_automata_number_words_and_find_one_error():
    rng = random.Random(2)
    for rep in range(150):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(0 if rep % 2 else 3, 8))) for _ in range(rng.randrange(60))})
        asked = Letters.of(pa.array(words, pa.string()))
        forward = Automaton.build(asked, np.arange(len(words)).reshape(-1, 1))
        order = sorted(range(len(words)), key=lambda i: words[i][::-1])
        backward = Automaton.build(Letters.of(pa.array([words[i][::-1] for i in order], pa.string())), np.array(order, np.int64).reshape(-1, 1))
        for i, word in enumerate(words):
            state, number = np.array([forward.root]), np.array([0])
            for c in word:
                _, state, number = forward.step(state, number, np.array([ord(c)]))
            assert number[0] == i and forward.final[state[0]]
        a, x = forward.one_error(asked, asked.size // 2)
        b, y = backward.one_error(asked.backward(), asked.size - asked.size // 2)
        got = set(zip(a.tolist(), x.tolist(), strict=True)) | set(zip(b.tolist(), backward.note[y, 0].tolist(), strict=True))
        assert got == {(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if near(u, v)}


def test_an_automaton_is_minimal_and_survives_its_file(tmp_path):
    words = sorted(f"{a}{b}ing" for a in "abcdefgh" for b in "xyz")
    asked = Letters.of(pa.array(words))
    a = Automaton.build(asked, np.arange(len(words)).reshape(-1, 1))
    assert len(a.final) == 6 and len(a.key) == 8 + 3 + 3
    a.save(f"file://{tmp_path}/a.dawg")
    b = Automaton.load(f"file://{tmp_path}/a.dawg")
    for x, y in zip(a.one_error(asked, asked.size // 2), b.one_error(asked, asked.size // 2), strict=True):
        assert (x == y).all()


def test_crc32_of_segments():
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = rng.integers(0, 2000, 400)
    end = start + rng.integers(0, 90, 400)
    of = rng.integers(0, 3, 400)
    heads = [b"", b"12:", b"-7:"]
    want = [zlib.crc32(heads[k] + buf[a:b].tobytes()) for k, a, b in zip(of, start, end, strict=True)]
    assert crc32_after(heads, of, buf, start, end).tolist() == want


def test_words_are_counted_and_damaged(spark):
    rng = random.Random(4)
    letters = "abcXYZéÀ×ÿß1 -\nœ"
    rows = [(rng.choice([i, None]), rng.choice(["".join(rng.choice(letters) for _ in range(rng.randrange(80))), None, ""])) for i in range(300)]
    rows += [(5, "a" * 50000), (6, None), (6, "Été été ÉTÉ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for damage in (None, 3):
        want = Counter()
        for i, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                word = "".join(c.lower() if c < "\x80" else c for c in run)
                h = zlib.crc32(f"{i}:{word}".encode())
                if damage and i is not None and h % damage == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                want[word] += 1
        want.pop("", None)
        assert {r.word: r.n for r in latin_words(df, damage).collect()} == want
    assert latin_words(df.limit(0)).count() == 0


def test_forms_equal_a_comparison_of_all_pairs(spark):
    rng = random.Random(6)
    for size, letters, most in ((7, "ab", 7), (50, "abcé", 9), (50_000, "abc", 6)):
        counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(most))): rng.randrange(1, 40) for _ in range(400)}
        rows = [(w, n, "x") for w, n in counts.items()]
        df = spark.createDataFrame([*rows, (None, 7, "x")], "word string, n long, form string").repartition(5)
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_forms(df, size=size).collect()}
        assert got == plain_forms(counts)


def test_pairs_stand_once_each_way(spark):
    words = ["aaaaa", "aaaaaa", "aaaba", "aaabb", "zzzzz"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = [(r.number, r.near) for r in near_words(numbered(df, "word", "w", "number"), 2).collect()]
    want = {(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if near(u, v)}
    assert len(pairs) == len(want) and set(pairs) == want


def test_chains_of_forms(spark):
    n = 37
    got = roots(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "number long, form long")).collect()
    assert {r.number: r.root for r in got} == {**dict.fromkeys(range(n), n), 100: 101}
    assert roots(spark.createDataFrame([], "number long, form long")).count() == 0


def test_odd_words(spark):
    long = "b" * 3000
    rows = [("Paris", 9), ("Paris", 1), ("Pariss", None), (long, 3), (long + "b", 8), ("漢字漢", 1), ("漢字", 2), ("", 1), ("q", 5), (None, 3)]
    df = spark.createDataFrame(rows, "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_forms(df, size=2).collect()}
    counts = Counter()
    for w, n in rows:
        if w is not None:
            counts[w] += n or 0
    assert got == plain_forms(dict(counts))
    assert spelling_forms(df.limit(0)).count() == 0
