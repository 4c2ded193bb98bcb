"""Exact n-gram Jaccard join by token-group matrices (operator 2).

1. Each text becomes the set of its distinct word n-grams (64-bit hashes). Texts with equal
   sets form one class; all that follows works on classes.
2. Candidates: at a Jaccard similarity of t or more, two sets of sizes up to s differ in at
   most k = (1-t)/(1+t) * 2s tokens. Tokens are dealt to buckets by hash, somewhat more than k. At
   most k of them can differ, so of those that aren't empty in one set all but k agree. A
   class is listed under the hash of each bucket; a bucket of a near copy agrees as a whole, so a
   frequent passage alone makes no hot entry. (Classes that fill no more than k buckets are listed
   together.)
3. Similar classes are partitioned into groups (by the smallest class they share a bucket
   with, the group's lead). A class queries each group that has all but k of its buckets. Members
   are compared with their lead first; what these links join needs no more
   comparison within the lead's component, so a group of very many near copies is done. Then
   members outside the lead's component meet all queries, and members in it the queries
   outside it. Large groups are split into blocks, so a cell (block of a group, block of
   queries) is bounded in sets and in tokens.
4. In a cell, members are divided into row groups of similar sets (by their smallest hash, a
   MinHash, and size); the token-group matrix holds each row group's token union. One product
   of query sets and matrix bounds the overlap of each query with each row group; only row
   groups whose bound admits the needed overlap are opened, and their members are compared
   exactly.
5. A cell passes on a spanning forest of its links, never all pairs. Components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded, forget_shuffles, settle, small_batches
from .textcore import mix, pieces, window_hash, words_of

RATIO = 1.4  # sizes of a bucket scheme: up to this times its smallest
BLOCK = 1024  # members, or queries, of a cell, in the mean at most
TOKENS = 1 << 18  # tokens of a cell's members, or queries, in the mean at most
ROWS = 32  # members of a row group
MOST = 2_000_000  # rows (of two numbers) of a table that is broadcast; a larger one is joined by a shuffle
LAST = 2**63 - 1
ENOUGH = 1 << 20  # what the weights of the buckets that a pair has to agree in add up to


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): sorted distinct n-gram hashes of each text, one text after another. A
    text of fewer words gives its whole sequence as one; without words the set is empty."""
    w = words_of(texts, "space_lower")
    doc, _, h = w.windows(n)
    count = w.count()
    for size in range(1, n):
        own = np.flatnonzero(count == size)
        doc = np.concatenate((doc, own))
        h = np.concatenate((h, window_hash(w.hash, size)[w.first[:-1][own]] if len(own) else h[:0]))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit key of each set (meaningless for an empty one)."""
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(1)), out=run[1:])
    return mix(run[first[1:]] - run[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _class_of(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / np.log(RATIO) + 1e-9).astype(np.int64)


@lru_cache
def _buckets(scheme: int, top: int, k: int) -> int:
    """How many buckets a scheme has: of its smallest sets all but a few fill more than k of them."""
    least, spare = max(1.0, RATIO**scheme), 1
    while (m := k + 2 + k // 16 + spare) < 40 * top:
        empty = m * exp(-least / m)
        if empty + 4 * sqrt(empty) + 1 <= spare:
            break
        spare += 1 + spare // 50
    return m


def bucket_keys(h: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, key, weight) of each bucket under which a set is listed, for similarity
    num/den: the weights of the keys that two near sets have in common add up to ENOUGH."""
    size = np.diff(first)
    own = _class_of(size)
    doc = np.repeat(np.arange(len(size)), size)
    out_doc, out_key, out_weight = [], [], []
    # a partner is up to den/num times larger, so it may be of a later scheme: the larger of two sets
    # is listed under its own, the smaller under all up to that of its largest partner
    over = _class_of(size * den // num)
    for further in range(int((over - own).max(initial=0)) + 1):
        scheme, use = own + further, over >= own + further
        top = np.ceil(RATIO ** (scheme + 1) + 1).astype(np.int64)
        k = 2 * top * (den - num) // (den + num)
        use = use & (k > 0) & (size > 0)
        m = np.array([_buckets(int(s), int(t), int(x)) if u else 0 for s, t, x, u in zip(scheme, top, k, use, strict=True)], np.int64)
        base = np.cumsum(m) - m
        mine = use[doc]
        d, x = doc[mine], h[mine]
        slot = base[d] + ((x >> np.uint64(20)) % m[d].astype(np.uint64)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, x = slot[order], mix(x[order])
        head = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, np.int64)
        total = np.add.reduceat(x, head) if len(head) else x
        of = np.searchsorted(base + m, slot[head], "right")
        place = (slot[head] - base[of]).astype(np.uint64)
        out_doc.append(of)
        out_key.append(mix(total + mix((scheme[of].astype(np.uint64) << np.uint64(40)) + place + np.uint64(1))))
        # at most k of a set's buckets differ from a near one's, so all others that aren't empty agree
        sure = np.bincount(of, minlength=len(m)) - k
        out_weight.append(-(-ENOUGH // np.maximum(sure[of], 1)))
        scarce = np.flatnonzero(use & (sure < 2))
        out_doc.append(scarce)
        out_key.append(mix(scheme[scarce].astype(np.uint64) + np.uint64(1 << 60)))
        out_weight.append(np.full(len(scarce), ENOUGH, np.int64))
    return np.concatenate(out_doc), np.concatenate(out_key).view(np.int64), np.concatenate(out_weight).astype(np.int32)


def links_of(members: list[np.ndarray], queries: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links (query, member) that span all components of the links between the two lists."""
    order = np.lexsort(([len(s) for s in members], [s[0] for s in members]))
    m_size = np.array([len(members[i]) for i in order])
    q_size = np.array([len(s) for s in queries])
    tokens = np.unique(np.concatenate(members))
    width = len(tokens)
    parent = list(range(len(members) + len(queries)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    groups = [order[i : i + ROWS] for i in range(0, len(order), ROWS)]
    matrix = np.zeros((len(groups), width), np.float32)
    for g, rows in enumerate(groups):
        for i in rows:
            matrix[g, np.searchsorted(tokens, members[i])] = 1
    least, most = (what.reduceat(m_size, np.arange(0, len(m_size), ROWS)) for what in (np.minimum, np.maximum))
    step = max(1, (4 << 20) // max(width, 1))
    found: list[tuple[int, int]] = []
    for lo in range(0, len(queries), step):
        part = queries[lo : lo + step]
        q = np.zeros((len(part), width), np.float32)
        for i, s in enumerate(part):
            at = np.searchsorted(tokens, s)
            at[at == width] = 0
            q[i, at[tokens[at] == s]] = 1
        size = q_size[lo : lo + step]
        # needed overlap with the smallest member, and sizes that can be near enough
        need = num * (size[:, None] + least[None, :])
        bound = (q @ matrix.T).astype(np.int64)
        opened = ((num + den) * bound >= need) & (den * most[None, :] >= num * size[:, None]) & (num * least[None, :] <= den * size[:, None])
        for g in np.flatnonzero(opened.any(axis=0)).tolist():
            rows, asks = groups[g], np.flatnonzero(opened[:, g])
            block = np.zeros((len(rows), width), np.float32)
            for i, r in enumerate(rows):
                block[i, np.searchsorted(tokens, members[r])] = 1
            both = (q[asks] @ block.T).astype(np.int64)
            own = np.array([len(members[r]) for r in rows])
            a, b = np.nonzero((num + den) * both >= num * (size[asks][:, None] + own[None, :]))
            for x, y in zip(asks[a].tolist(), rows[b].tolist(), strict=True):
                s, t = root(len(members) + lo + x), root(y)
                if s != t:
                    parent[s] = t
                    found.append((lo + x, y))
    return found


def _cells(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, part, c, b, k, role, tokens), sorted by cell: links of each cell as (a, b)."""
    cell, rows = None, []

    def close() -> tuple[list[int], list[int]]:
        sets = {k: np.frombuffer(t, np.uint64) for k, _, t in rows}
        mk, qk = [k for k, role, _ in rows if role & 1], [k for k, role, _ in rows if role & 2]
        if not mk or not qk or len(sets) < 2:
            return [], []
        pairs = links_of([sets[k] for k in mk], [sets[k] for k in qk], num, den)
        both = [(qk[x], mk[y]) for x, y in pairs if qk[x] != mk[y]]
        return [x for x, _ in both], [y for _, y in both]

    for batch in batches:
        a, b = [], []
        for *at, k, role, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if at != cell:
                if rows:
                    x, y = close()
                    a, b = a + x, b + y
                cell, rows = at, []
            rows.append((k, role, t))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    if rows:
        a, b = close()
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _linked(holds: DataFrame, asks: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that span those between members holds and queries asks (both g, part, k, size)
    of each part of a group."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(x: DataFrame, name: str) -> DataFrame:
        n = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / TOKENS)).cast("int")
        return x.groupBy("g", "part").agg(n.alias(name))

    split = blocks(holds, "mb").join(blocks(asks, "qb"), ["g", "part"])
    h = F.xxhash64("k")
    one, every = lambda n: F.pmod(h, n).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = asks.join(split, ["g", "part"]).select("g", "part", every("mb").alias("c"), one("qb").alias("b"), "k", F.lit(2).alias("role"))
    holds = holds.join(split, ["g", "part"]).select("g", "part", one("mb").alias("c"), every("qb").alias("b"), "k", F.lit(1).alias("role"))
    cell = ["g", "part", "c", "b"]
    wanted = asks.unionByName(holds).groupBy(*cell, "k").agg(F.sum("role").cast("int").alias("role"))
    filled = wanted.join(tokens, "k").select(*cell, "k", "role", "tokens")
    filled = filled.repartition(parts, *cell).sortWithinPartitions(*cell)
    return settle(filled.mapInArrow(lambda it: _cells(it, num, den), "a long, b long"), "links")


def _classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """known (doc_id, id, copy, n_shingles, k) of each row, k telling its set (null: an empty
    one), and (k, component) of each set that is linked with another."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("copy", F.xxhash64("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h, first = shingle_sets(b.column("text"), n)
            size = np.diff(first)
            own = {c: b.column(c) for c in ("doc_id", "id", "copy")}
            yield pa.RecordBatch.from_pydict(own | {"n_shingles": size, "k": pa.array(set_keys(h, first), mask=size == 0)})

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in pieces(batches):
            h, first = shingle_sets(b.column("text"), n)
            own = set_keys(h, first)
            size = np.diff(first)
            # copies met in this task are listed once
            _, at = np.unique(own, return_index=True)
            fresh = np.zeros(len(own), bool)
            fresh[at] = True
            fresh &= (size > 0) & ~np.isin(own, seen)
            seen = np.union1d(seen, own[fresh])
            kept = np.repeat(fresh, size)
            doc, key, weight = bucket_keys(h[kept], np.concatenate(([0], np.cumsum(size[fresh]))), num, den)
            yield pa.RecordBatch.from_pydict({"key": key, "k": own[fresh][doc], "w": weight})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h, first = shingle_sets(b.column("text"), n)
            tokens = pa.array([h[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict({"k": pa.array(set_keys(h, first)), "tokens": tokens})

    known = settle(rows.mapInArrow(keys, "doc_id long, id long, copy long, n_shingles long, k long"), "classes")
    classes = known.where("k is not null").groupBy("k").agg(F.min(F.struct("id", "copy")).alias("at"), F.max("n_shingles").alias("size"))
    each = rows.mapInArrow(buckets, "key long, k long, w int")
    # aggregated before the shuffle, so a bucket of very many sets is no load for one task
    shared = each.groupBy("key").agg(F.min("k").alias("lead"), F.max("k").alias("last")).where("lead <> last").select("key", "lead")
    listed = settle(each.join(bounded(shared, "shared", MOST), "key").distinct(), "buckets")
    forget_shuffles(rows.sparkSession)
    group = listed.groupBy("k").agg(F.min("lead").alias("g"))
    of = listed.select("key", "k", "w").join(group, "k").join(classes.select("k", "size"), "k")
    span = [F.min("size").alias("lo"), F.max("size").alias("hi")]
    fits = (den * F.col("hi") >= num * F.col("size")) & (den * F.col("size") >= num * F.col("lo"))
    # a partner in a group agrees in enough buckets, these are in the group, and sizes are near
    asked = of.select("key", "k", "w", "size").join(of.groupBy("key", "g").agg(*span), "key").where(fits)
    asked = asked.groupBy("k", "g").agg(F.sum("w").alias("n")).where(F.col("n") >= ENOUGH).select("k", "g")
    cells = asked.join(group.withColumn("own", F.lit(1)), ["k", "g"], "left").select("k", "g", F.col("own").isNotNull().alias("own"))
    cells = settle(cells.join(classes.select("k", "size"), "k"), "cells")
    forget_shuffles(rows.sparkSession)
    # the one text from which a set's tokens are taken
    needed = classes.join(cells.select("k").distinct(), "k", "left_semi").select("at.id", "at.copy")
    needed = bounded(needed, "needed", MOST)
    tokens = settle(rows.join(needed, ["id", "copy"], "left_semi").select("text").mapInArrow(sets, "k long, tokens binary").dropDuplicates(["k"]), "tokens")
    lead = cells.where("k = g").select("g", F.lit(0).alias("part"), "k", "size")
    first = _linked(lead, cells.where("own and k <> g").select("g", F.lit(0).alias("part"), "k", "size"), tokens, num, den)
    label = settle(components(first), "joined")
    forget_shuffles(rows.sparkSession)
    name = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"{c}_of"))
    rest = cells.join(name("k"), "k", "left").join(name("g"), "g", "left")
    inside = F.coalesce("k_of", "k") == F.coalesce("g_of", "g")
    rest = settle(rest.select("g", "k", "size", "own", inside.alias("inside")), "rest")
    # part 1: members outside the lead's component and all queries; part 2: members in it and queries outside it
    two = F.when(F.col("inside"), 2).otherwise(1).alias("part")
    holds = rest.where("own").select("g", two, "k", "size")
    # which members a query agrees with in enough buckets
    at = of.join(holds.select("k", "g", "part"), ["k", "g"]).groupBy("key", "g", "part").agg(*span)
    asks = of.select("key", "k", "w", "size").join(at, "key").where(fits).groupBy("k", "g", "part").agg(F.sum("w").alias("n")).where(F.col("n") >= ENOUGH).drop("n")
    asks = asks.join(rest.select("k", "g", "size", "inside"), ["k", "g"]).where("part = 1 or not inside").drop("inside")
    forget_shuffles(rows.sparkSession)
    more = _linked(holds, asks, tokens, num, den)
    if more.isEmpty():
        joined = label
    else:
        joined = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    return known, joined.select(F.col("id").alias("k"), "component")


def similar_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text; other columns,
    whatever their names, are left out): documents link when den * intersection >= num * union
    of their n-gram sets.

    component_id is the smallest doc_id reachable by links, itself included. Null and empty
    texts have an empty set and stand alone. Rows with one doc_id count as one text each. A
    null doc_id is never a component's id unless nothing else is there. An empty table gives no
    rows; texts are taken whole, however long.
    """
    known, joined = _classes(docs, n, num, den)
    classes = known.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("least")).join(joined, "k", "left")
    classes = classes.withColumn("component", F.coalesce("component", "k"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    label = classes.join(least, "component").select("k", "component_id")
    return known.join(label, "k", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def without_similar(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs (doc_id, text; all columns are kept, whatever their names) with one row of each
    component of similar_components: that of the smallest doc_id (null last), then of the
    smallest hash of its text; of rows equal in both, one of them. Texts without words stay.
    An empty table gives no rows; texts are taken whole, however long.
    """
    known, joined = _classes(docs, n, num, den)
    member = known.where("k is not null").select("id", "copy", "k").distinct().join(joined, "k", "left").withColumn("component", F.coalesce("component", "k"))
    stays = member.groupBy("component").agg(F.min(F.struct("id", "copy")).alias("at")).select("at.id", "at.copy", F.lit(True).alias("stays"))
    alone = known.where("k is null").select("id", "copy", F.lit(False).alias("stays")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"))
    row = row.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col("row.text").cast("string")).alias("copy"))
    found = row.join(stays.unionByName(alone), ["id", "copy"])
    out = found.where("stays").dropDuplicates(["id", "copy"]).unionByName(found.where("not stays"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))
