"""License scans as an exact set-similarity join (operator 1).

Texts are cut into overlapping blocks of words. A block matches a template if it contains at
least the template's threshold of its distinct words. Words are ordered globally by their
number in all texts, the rarest first. To hold o of a template's m words, a block must hold
one of its m - o + 1 rarest (prefix filter); the words left in both after that first common
one must suffice (positional filter); a block must have o words of templates at all (length
filter). Pairs that pass are verified by their exact overlap. Words that no template has can't
add to an overlap and are left out of blocks beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, small_batches
from .textcore import pieces, segment_hash, words_of

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words of license notices in general use.
NOTICES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
}
MAX_TEMPLATE_WORDS = 1_000_000  # all templates together: they go to each task


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(segment_hash(raw, np.array([0]), np.array([len(raw)]))[0])


def license_matches(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, threshold: float = 0.8, stride: int = 64) -> DataFrame:
    """docs (doc_id, text; other columns are left out), a row for each: doc_id, n_words,
    places (array of (start, label): where a phrase's words stand one after another, by
    start), found (labels of notices that a block holds to the threshold) and best (largest
    share of a matching template's words in one block, 0 without a match).

    Blocks are 2 * stride words long and begin at each multiple of stride, so each passage of
    up to stride + 1 words lies whole in one. For notices of more than stride words, whole licences
    for instance, there are blocks of twice, four times, ... that length as well: each is compared
    with blocks of the smallest stride that is no shorter. Null text counts as empty; each row
    counts for itself, whatever its doc_id; an empty table gives no rows, and without any
    template nothing is found. Texts are taken whole, however long. A template without words is
    left out.
    """
    small_batches(docs.sparkSession)
    templates = [(t.split(), label, 1.0) for t, label in phrases.items() if t.split()]
    n_phrases = len(templates)
    templates += [(t.split(), label, threshold) for t, label in notices.items() if t.split()]
    if sum(len(w) for w, _, _ in templates) > MAX_TEMPLATE_WORDS or any(len(w) > stride for w, _, _ in templates[:n_phrases]):
        raise ValueError("templates are too long")
    # how often the stride is doubled for each template
    level = [max(0, ceil(log2(len(w) / stride))) for w, _, _ in templates]
    levels = sorted({0, *level})
    vocabulary = sorted({w for words, _, _ in templates for w in words})
    code = sorted((_hash(w), i) for i, w in enumerate(vocabulary))
    hashes, numbers = np.array([h for h, _ in code], np.uint64), np.array([i for _, i in code], np.int64)

    def known(w) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of each word that templates have."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
        place = np.flatnonzero(hashes[at] == w.hash)
        return place, numbers[at[place]]

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for b in pieces(batches):
            total += np.bincount(known(words_of(b.column("text"), "alnum"))[1], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": np.arange(len(total)), "n": total})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(frequency, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = {r["word"]: r["n"] for r in counts.collect()}  # a row for each word of the templates
    order = sorted(range(len(vocabulary)), key=lambda i: (often.get(i, 0), vocabulary[i]))
    rank = np.empty(len(vocabulary), np.int64)
    rank[order] = np.arange(len(order))
    ranks = {w: int(rank[i]) for i, w in enumerate(vocabulary)}

    spark, table, prefix = docs.sparkSession, [], []
    for number, (words, label, share) in enumerate(templates):
        own = sorted({ranks[w] for w in words})
        need = ceil(share * len(own) - 1e-9)
        phrase = [ranks[w] for w in words] if number < n_phrases else None
        table.append((number, label, own, need, phrase))
        prefix += [(token, level[number], number, i, len(own), need) for i, token in enumerate(own[: len(own) - need + 1])]
    fewest = min((need for _, _, _, need, _ in table), default=1)
    # words of the templates of each level
    used = {x: np.zeros(len(vocabulary), bool) for x in levels}
    for number, (words, _, _) in enumerate(templates):
        used[level[number]][[ranks[w] for w in words]] = True
    table_df = spark.createDataFrame(table, "template int, label string, own array<long>, need int, phrase array<long>")
    prefix_df = spark.createDataFrame(prefix, "token long, level int, template int, i int, m int, need int")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = words_of(b.column("text"), "alnum")
            place, token = known(w)
            for x in levels:
                mine = used[x][rank[token]]
                yield level_blocks(b, w, place[mine], rank[token[mine]], x)

    def level_blocks(b: pa.RecordBatch, w, place: np.ndarray, token: np.ndarray, x: int) -> pa.RecordBatch:
        doc = w.doc()[place]
        at = place - w.first[doc]
        # a word lies in the block of its own stride and in the one before
        home = at // (stride << x)
        keys = np.concatenate((doc * (1 << 32) + home, (doc * (1 << 32) + home - 1)[home > 0]))
        pos, tok = np.concatenate((at, at[home > 0])), np.concatenate((token, token[home > 0]))
        o = np.lexsort((pos, keys))
        keys, pos, tok = keys[o], pos[o], tok[o]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(keys)))
        of, block = keys[head] >> 32, keys[head] & 0xFFFFFFFF
        # each row has a block, of the first level
        none = np.setdiff1d(np.arange(b.num_rows), of) if not x else of[:0]
        of, block = np.concatenate((of, none)), np.concatenate((block, np.full(len(none), -1)))
        cut = pa.array(np.concatenate(([0], np.cumsum(size), np.full(len(none), len(keys)))), pa.int32())
        take = pa.array(of)
        return pa.RecordBatch.from_pydict({
            "row": b.column("row").take(take), "doc_id": b.column("doc_id").take(take), "n_words": w.count()[of], "level": pa.array(np.full(len(of), x), pa.int32()), "block": block,
            "pos": pa.ListArray.from_arrays(cut, pa.array(pos, pa.int64())), "tok": pa.ListArray.from_arrays(cut, pa.array(tok, pa.int64())),
        })

    fields = "row long, doc_id long, n_words long, level int, block long, pos array<long>, tok array<long>"
    # written, so that a row has one number in both uses whatever task runs again
    cut = settle(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(blocks, fields), "blocks")
    # each block's template words, rarest first
    cut = cut.withColumn("own", F.sort_array(F.array_distinct("tok")))
    long_enough = cut.where((F.col("block") < 0) | (F.size("own") >= fewest))
    probes = long_enough.where("block >= 0").select("*", F.posexplode("own").alias("j", "token"))
    # templates are bounded by MAX_TEMPLATE_WORDS
    met = probes.join(F.broadcast(prefix_df), ["token", "level"])
    met = met.where(F.least(F.col("m") - F.col("i"), F.size("own") - F.col("j")) >= F.col("need"))
    met = met.select("row", "doc_id", "n_words", "block", "pos", "tok", F.col("own").alias("block_own"), "template", "i", "j")
    met = met.join(F.broadcast(table_df), "template")
    both = F.array_intersect("own", "block_own")
    # each pair once: at its first common word
    met = met.withColumn("both", both).where((F.size("both") >= F.col("need")) & (F.element_at("both", 1) == F.get("own", F.col("i"))))
    starts = F.expr(f"""
        CASE WHEN phrase IS NULL THEN array() ELSE transform(filter(
            sequence(0, size(tok) - size(phrase)),
            i -> slice(tok, i + 1, size(phrase)) = phrase AND pos[i + size(phrase) - 1] - pos[i] = size(phrase) - 1 AND pos[i] div {stride} = block
        ), i -> pos[i]) END""")
    met = met.select(
        "row", "doc_id", "n_words", "label", "phrase", (F.size("both") / F.size("own")).alias("share"),
        F.when(F.size("tok") >= F.coalesce(F.size("phrase"), F.lit(0)), starts).otherwise(F.expr("array()")).cast("array<long>").alias("starts"),
    )
    met = met.where("phrase IS NULL OR size(starts) > 0").select(
        "row", "doc_id", "n_words", F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("label").alias("label"))).alias("p"),
        F.when(F.col("phrase").isNull(), F.col("label")).alias("notice"), "share",
    )
    kind = {c: t for c, t in met.dtypes}
    alone = cut.groupBy("row", "doc_id", "n_words").agg(F.lit(0.0).alias("share"))
    alone = alone.select("row", "doc_id", "n_words", F.lit(None).cast(kind["p"]).alias("p"), F.lit(None).cast("string").alias("notice"), "share")
    return alone.unionByName(met).groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("p"))).alias("places"), F.sort_array(F.collect_set("notice")).alias("found"), F.max("share").alias("best")
    ).drop("row")
