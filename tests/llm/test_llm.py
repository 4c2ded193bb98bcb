"""Operators against brute force, round trips and odd inputs."""

import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import queries as Q
from ledgerloom.llm.decontaminate import contamination
from ledgerloom.llm.jaccard_join import links_of, similar_components, without_similar
from ledgerloom.llm.license_scan import license_matches
from ledgerloom.llm.near_lines import dedup_lines, line_decisions
from ledgerloom.llm.packing import best_fit, pack
from ledgerloom.llm.quality_knn import score_quality
from ledgerloom.llm.quality_rules import judged, measures, scored
from ledgerloom.llm.repeats import without_repeats
from ledgerloom.llm.shared import settle
from ledgerloom.llm.sharding import byte_shards
from ledgerloom.llm.tokens import Encoder, token_table

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, n_words long, spans string, shard string, key string, score string, kept string, _keep string, _id string, _size string, id string, copy string, row string, gone string"
WORD, BYTE = Q.tokenizer_path("word_bpe_49k.json"), Q.tokenizer_path("byte_bpe_50k.json")


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (None, "a b c d e f"), (2, ""), (3, " \n\t"), (4, long), (5, long), (5, long), (6, "x"), (7, "x"), (None, None), (8, "MIT License\nMIT License")]
    return spark.createDataFrame([(i, t, None if i == 6 else "en", 1, "s", "s", "k", "x", "y", *"abcdefg") for i, t in rows], SCHEMA)


OPERATORS = {
    "license": license_matches,
    "jaccard": similar_components,
    "repeats": without_repeats,
    "tokens": lambda d: token_table(d, WORD, 2),
    "packing": lambda d: pack(d, BYTE, 0),
    "lines": lambda d: dedup_lines(d),
    "similar": without_similar,
    "knn": lambda d: score_quality(d, d.sparkSession.createDataFrame([(4, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")),
    "winnow": lambda d: contamination(d, d.sparkSession.createDataFrame([(1, "x"), (None, "mit license"), (2, None)], "item_id long, text string")),
    "shards": lambda d: byte_shards(d.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 16), ["doc_id", "size"], "size", 4),
    "rules": lambda d: judged(scored(d)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    df = odd(spark)
    out = OPERATORS[name](df)
    rows = out.collect()
    n = df.count()
    if name == "lines":  # of the lines "x", the long text's and "MIT License" one each; the row with the second "x" and a third row go
        assert sorted((r.doc_id, r.text) for r in rows if r.text and len(r.text) < 99 and r.doc_id) == [(3, " \n\t"), (6, "x"), (8, "MIT License")]
        assert len(rows) == n - 3 and out.columns == df.columns
    elif name == "similar":  # one of the three long texts, one of the two "x"
        assert len(rows) == n - 3 and out.columns == df.columns and {4, 6, 8} <= {r.doc_id for r in rows}
    else:
        assert len(rows) >= n if name == "packing" else len(rows) == n
    for r in rows:
        if name in ("lines", "similar", "shards", "knn", "winnow", "rules"):
            assert [r[c] for c in ("_keep", "_id", "_size", "id", "copy", "row", "gone")] == list("abcdefg")
    assert OPERATORS[name](df.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = Q.QUERIES[name](spark, str(DATA)).toPandas(), con.sql(Q.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    show = lambda df: Counter(map(tuple, df[cols].map(lambda v: "" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)).values.tolist()))
    a, b = got.astype({c: float for c in cols if pd.api.types.is_numeric_dtype(got[c])}), want.astype({c: float for c in cols if pd.api.types.is_numeric_dtype(got[c])})
    assert show(a) == show(b)


def texts(seed, n):
    r = random.Random(seed)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "1", ".", ",", "é", " ", " ", "###", "<|endoftext|>", "\x1c", "Ж"]
    return ["", " ", "\n\n"] + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("path, keeps", [(WORD, False), (BYTE, True)])
def test_encoder_equals_the_library(path, keeps):
    e, plain, own = Encoder(path, keeps), Tokenizer.from_file(path), texts(1, 1500)
    own += ["a <|endoftext|> b", "<|startoftext|>x y", "<|ENDOFTEXT|>", "one two\n<|endoftext|><|endoftext|>"]
    for _ in range(2):
        ids, count = e.encode(pa.array(own))
        want = [plain.encode(t, add_special_tokens=False).ids for t in own]
        assert count.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert e.known_rules


def test_other_tokenizers_are_taken_whole():
    e, plain, own = Encoder(BYTE, False), Tokenizer.from_file(BYTE), texts(2, 200)
    assert not e.known_rules
    ids, count = e.encode(pa.array(own))
    want = [plain.encode(t, add_special_tokens=False).ids for t in own]
    assert count.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files_read_back(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-5, "a <|endoftext|> b"), (-4, None)], docs.schema))
    plain, at = Tokenizer.from_file(WORD), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_table(docs, WORD, 2).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (at, len(ids), crc(ids))
        at += len(ids)


def best_fit_decreasing(sizes, capacity):
    """The number of sequences that the sequential rule opens."""
    gaps, opened = [], 0
    for n in sorted(sizes, reverse=True):
        i = bisect_left(gaps, n)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        opened += gap == capacity
        if gap > n:
            insort(gaps, gap - n)
    return opened


@pytest.mark.parametrize("kind", ["mixed", "small", "equal", "large"])
def test_best_fit_in_rounds(spark, kind):
    r = random.Random(5)
    draw = {"mixed": lambda: r.choice([r.randint(1, 100), r.randint(1, 20)]), "small": lambda: r.randint(1, 5), "equal": lambda: r.choice([40, 40, r.randint(1, 100)]), "large": lambda: r.randint(40, 100)}[kind]
    sizes = [draw() for _ in range(1500)]
    rows = best_fit(spark.createDataFrame(list(enumerate(sizes)), "rank long, length long"), 100).collect()
    assert sorted(x["rank"] for x in rows) == list(range(len(sizes)))
    held = defaultdict(list)
    for x in rows:
        held[x.sequence_id].append((x.offset, sizes[x["rank"]]))
    for v in held.values():
        place = 0
        for a, n in sorted(v):
            assert a == place
            place += n
        assert place <= 100
    assert len(held) <= best_fit_decreasing(sizes, 100) * 1.01 + 1


def test_packing_holds_every_token_once(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-5, "a <|endoftext|> b"), (-4, None)], docs.schema))
    rows = pack(docs, BYTE, 0).collect()
    seq, doc = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for v in seq.values():
        ends = [0, *(a + n for a, n in sorted(v))]
        assert [a for a, _ in sorted(v)] == ends[:-1] and ends[-1] <= 2048
    plain, lengths = Tokenizer.from_file(BYTE), []
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        assert sorted(doc[r.doc_id]) == [(i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        lengths += [b - a for a, b in zip(cuts, cuts[1:])]
    assert len(seq) <= best_fit_decreasing(lengths, 2048) * 1.01 + 1


def test_dedup_lines_rewrites_texts(spark):
    df = spark.createDataFrame([(1, "one line here\nother stuff there", 7), (2, "other stuff there\nthird thing now", 8), (3, "one line here", 9), (4, None, 1), (5, "", 2)], "doc_id long, text string, x int")
    assert sorted((r.doc_id, r.text, r.x) for r in dedup_lines(df).collect() if r.text) == [(1, "one line here\nother stuff there", 7), (2, "third thing now", 8)]
    assert dedup_lines(df).count() == 4


def test_frequent_grams_are_followed_in_parts(monkeypatch):
    import numpy as np

    from ledgerloom.llm import decontaminate as D

    index = D.Index("", {})
    index.part = {"k": np.array([1, 2, 2, 2, 2, 5, 5], np.uint64), "v": np.arange(7)}
    for most in (1, 2, 3, 5, 100):
        monkeypatch.setattr(D, "PAIRS", most)
        parts = [list(zip(i.tolist(), q.tolist())) for i, q in index.pairs(np.array([5, 2, 9, 2], np.uint64), "k", "v")]
        assert max(map(len, parts)) <= most and sorted(sum(parts, [])) == sorted([(0, 5), (0, 6), *((i, j) for i in (1, 3) for j in (1, 2, 3, 4))])


def test_links_span_all_components():
    r = random.Random(2)
    import numpy as np

    base = [r.randrange(10**9) for _ in range(60)]
    sets = []
    for _ in range(120):
        own = set(base[: r.choice([60, 30])])
        for _ in range(r.randint(0, 4)):
            own.discard(r.choice(base))
            own.add(r.randrange(10**9))
        sets.append(own)
    pairs = links_of([np.array(sorted(s), np.uint64) for s in sets], [np.array(sorted(s), np.uint64) for s in sets], 9, 10)

    def label(links):
        p = list(range(len(sets)))

        def root(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in links:
            p[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(len(sets))]

    want = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])]
    assert label(pairs) == label(want)


def test_measures_equal_brute_force():
    own = [*texts(3, 300), "a b c d e f g h a b c d e f g h x", "p\nq\np\n\n\np"]
    got = measures(pa.array(own))
    for i, t in enumerate(own):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {p for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)]
        assert [int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want


def brute_kneser_ney(texts, order):
    """(probability by gram, backoff weight by context) of a modified Kneser-Ney model, from its definition."""
    count = Counter()
    for t in texts:
        padded = bytes(order - 1) + t.encode()
        count.update(padded[i : i + order] for i in range(len(t.encode())))
    levels = {order: count}
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    prob, gamma = {b"": 1 / 256}, {}
    for m in range(1, order + 1):
        c = levels[m]
        n = {i: sum(v == i for v in c.values()) for i in (1, 2, 3, 4)}
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = {i: max(min(i - (i + 1) * y * n[i + 1] / max(n[i], 1), i - 0.05), 0.05) for i in (1, 2, 3)}
        total, off = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            off[g[:-1]] += d[min(v, 3)]
        gamma |= {x: off[x] / total[x] for x in total}
        prob |= {g: (v - d[min(v, 3)]) / total[g[:-1]] + gamma[g[:-1]] * prob[g[1:]] for g, v in c.items()}
    return prob, gamma


def test_kneser_ney_equals_brute_force(spark, tmp_path):
    import numpy as np

    from ledgerloom.llm.quality_rules import Model, _models, kneser_ney, ngram_counts, write_model
    from ledgerloom.llm.textcore import buffer_of

    r = random.Random(8)
    own = [(" ".join(r.choice(["abra", "cadabra", "banana", "bandana", "cabana", "abba"]) for _ in range(r.randint(1, 9))), r.choice(["en", "de"])) for _ in range(40)]
    docs = spark.createDataFrame(own, "text string, lang string")
    levels = kneser_ney(ngram_counts(docs, 3), 3)
    buf, off = buffer_of(pa.array([t for t, _ in own]))
    codes = _models(pa.array([x for _, x in own]), buf, off, 1)
    model = Model(f"file://{tmp_path}", write_model(levels, f"file://{tmp_path}"))
    for code in np.unique(codes).tolist():
        prob, gamma = brute_kneser_ney([t for (t, _), c in zip(own, codes.tolist()) if c == code], 3)
        signed = int(np.uint64(code).view(np.int64))
        for m, level in enumerate(levels):
            for row in level.where(F.col("model") == signed).collect():
                gram = row.gram.to_bytes(m, "big")
                assert (row.logp is None) == (gram not in prob or not gram) and (row.logp is None or abs(np.exp(row.logp) - prob[gram]) < 1e-6)
                if m < 3:
                    assert abs(np.exp(row.backoff) - gamma.get(gram, 1)) < 1e-6
        back = lambda g: prob[g] if g in prob else gamma.get(g[:-1], 1) * back(g[1:])
        for context in (b"ab", b"na", b"zz", b"a ", b"\0\0"):
            grams = [context + bytes([c]) for c in range(256)]
            got = model.logp(np.full(256, code, np.uint64), np.array([int.from_bytes(g, "big") for g in grams], np.uint64))
            assert np.allclose(np.exp(got), [back(g) for g in grams], atol=1e-6) and abs(np.exp(got).sum() - 1) < 1e-5


def test_votes_on_held_out_rows(spark):
    docs = "/root/testdata/sf0.01"
    rows = Q.op7_quality_votes(spark, docs).join(spark.read.parquet(f"{docs}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    seen = docs.count()
    for name, stage in P.STAGES[:-1]:
        out = P.settle(stage(spark, docs, str(DATA)), name)
        assert out.columns == docs.columns and 0 < out.count() <= seen
        docs, seen = out, out.count()
    left = dict(P._LEFT)
    last = P.STAGES[-1][1](spark, docs, str(DATA))
    assert last.select("doc_id").distinct().count() == seen
    assert not any(Path(x.removeprefix("file://")).exists() for x in left.values())


def shingle_links(lines):
    """Pairs of distinct lines whose plain sets of five-character shingles have a similarity of 0.8 or more."""
    sets = {x: {x[i : i + 5] for i in range(max(len(x) - 4, 1))} for x in set(lines) if x.strip()}
    where, out = defaultdict(list), []
    for x, s in sets.items():
        both = Counter(y for g in s for y in where[g])
        out += [(x, y) for y, n in both.items() if 10 * n >= 8 * (len(s) + len(sets[y]) - n)]
        for g in s:
            where[g].append(x)
    return out


def line_links_missed(df):
    """Near equal lines that the operator doesn't join, and all of them: of each two, one goes."""
    rows = {r.doc_id: r.text for r in df.collect()}
    links = shingle_links(rows.values())
    gone = {rows[r.id] for r in line_decisions(df).collect()}
    return [p for p in links if not gone & set(p)], links


def test_line_dedup_goes_no_further_than_brute_force(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    lines = [(r.doc_id, j, x) for r in docs.orderBy("doc_id").collect() for j, x in enumerate(r.text.split("\n")) if x.strip()]
    first, parent = {}, {}
    for i, j, x in lines:
        first.setdefault(x, (i, j))
        parent.setdefault(x, x)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in shingle_links(first):
        a, b = sorted((root(x), root(y)), key=first.get)
        parent[b] = a
    want = {(i, j) for i, j, x in lines if first[root(x)] != (i, j)}
    got = {(r.id, r.line_no) for r in line_decisions(docs).collect()}
    assert not got - want and len(want - got) <= 0.05 * len({x for x in first if root(x) != x})


def test_near_lines_by_plain_shingles(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    lines = sorted({x for r in docs.collect() for x in r.text.split("\n")})
    missed, links = line_links_missed(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert len(links) > 20 and len(missed) <= 0.03 * len(links)
    apart = [(1, "And with."), (2, "Is with."), (3, "Zu. Für."), (4, "Für."), (5, "1 2 3 4 5 6 7"), (6, "7 6 5 4 3 2 1")]
    assert not line_decisions(spark.createDataFrame(apart, "doc_id long, text string")).count()


def test_near_lines_without_spaces_and_of_short_words(spark):
    r = random.Random(3)
    cjk = lambda n: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))
    low = lambda n: " ".join(r.choice("abcdefghijklmnop") + r.choice("aeiou") for _ in range(n))
    lines = []
    for n in (8, 12, 25, 40, 47, 49, 58, 61, 90, 300):
        for make in (cjk, lambda n: low(n // 3 + 3), lambda n: "".join(r.choice("xyzabcq") for _ in range(n))):
            x = make(n)
            lines += [x, x + "。"]
    missed, links = line_links_missed(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert len(links) >= 25 and not missed


def test_near_lines_in_crowded_bands(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(2):
        template = " ".join(word(6) for _ in range(12))
        for _ in range(150):
            own = f"{template} {word(60)}"
            lines += [own + word(6), own + word(6)]
    assert len(shingle_links(lines)) >= 300
    missed, links = line_links_missed(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert len(missed) <= 0.01 * len(links)


def test_perplexity_band_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r, planted = random.Random(4), []
    for lang in ("en", "de", "fr", "es"):
        prose = [x.text.split() for x in docs.where(F.col("lang") == lang).orderBy("doc_id").collect() if len(x.text.split()) >= 60][:8]
        low = "".join(sorted({c for w in prose for x in w for c in x if c.isalpha()}))
        planted += [(lang, " ".join("".join(r.choice(low) for _ in range(r.randint(2, 9))) for _ in range(120))) for _ in range(8)]
        planted += [(lang, " ".join(w + r.choice(["***", "$$$", "###", "%%%"]) for w in x)) for x in prose]
        planted += [(lang, " | ".join(w for w in x if len(w) > 4)) for x in prose]
        planted += [(lang, "".join(r.sample(" ".join(x), len(" ".join(x))))) for x in prose]
    rows = spark.createDataFrame([(-1 - i, x, lang) for i, (lang, x) in enumerate(planted)], docs.schema)
    out = judged(settle(scored(docs.union(rows)).drop("text"), "scored")).where("NOT base_failed").select("doc_id", "lang", "kept").collect()
    for lang in ("en", "de", "fr", "es"):
        junk = [x.kept for x in out if x.doc_id < 0 and x.lang == lang]
        assert len(junk) > 20 and sum(junk) <= 0.15 * len(junk)
    held = {x.doc_id: x.quality for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [x.kept for x in out if held.get(x.doc_id) == 1]
    assert sum(clean) >= 0.98 * len(clean)


def test_similar_rows_go_by_row(spark):
    w, v = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(4, w, 1), (5, w, 2), (5, v, 3), (None, v, 4), (None, w, 5), (6, None, 6), (6, "", 7), (6, "", 8)], "doc_id long, text string, x int")
    assert sorted(r.x for r in without_similar(df).collect()) == [1, 3, 6, 7, 8]
    only = spark.createDataFrame([(None, w), (None, w + " a"), (None, w + " b")], "doc_id long, text string")
    assert without_similar(only).count() == 1


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, stays string, kept string, _n string"


@pytest.mark.parametrize("at", range(5))
def test_stages_with_odd_rows(spark, at):
    import corpus_pipeline as P

    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (None, "a b c d e f"), (2, ""), (3, " \n\t"), (4, long), (5, long), (5, long), (6, "x"), (7, "x"), (None, None)]
    df = spark.createDataFrame([(i, t, None if i == 6 else "en", "s", 1, *"abcd") for i, t in rows], STAGE_SCHEMA)
    df = P.settle(df, "odd")
    stage = P.STAGES[at][1]
    out = P.settle(stage(spark, df, str(DATA)), "out")
    if at < 4:
        assert out.columns == df.columns
    want = {0: 3, 1: 7, 2: 7, 3: 10}.get(at)
    assert out.count() == want if want else out.select("doc_id").distinct().count() == 8
    assert P.settle(stage(spark, P.settle(df.limit(0), "none"), str(DATA)), "out").count() == 0
