"""Documents put together from what was found in fragments, pages and files.

A candidate is one value that was found: its field and value, the business keys that stand with it
(a voucher's number, say), and the range of the source that it was read from. Fragments overlap, so
one place is often read twice; a document goes on over pages, or over files.

1. Candidates with an equal key are of one document (in one file, or across files). Keyless
   ones that were read from overlapping ranges belong together.
2. A keyless group that overlaps candidates of one document joins it; one that overlaps several
   documents, or none, stays apart, for review.
3. Within a document, candidates of one field and file whose ranges overlap are one entry, met
   more than once. Equal values from ranges apart are entries of their own.

Links go through keys and through neighbours in order, never from each to each, so a key that a
third of all candidates have is as many links as candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def _to_roots(parents: DataFrame) -> DataFrame:
    """(id, p) with each parent replaced by the last one above it; parents are smaller than their
    children. Steps grow twice as long each time."""
    while True:
        above = parents.select(F.col("id").alias("at"), F.col("p").alias("then"))
        up = parents.join(above, F.col("p") == F.col("at"), "left")
        parents = written(up.select("id", F.coalesce("then", "p").alias("p"), (F.coalesce("then", "p") != F.col("p")).alias("moved")), "parents")
        if parents.where("moved").isEmpty():
            return parents.select("id", "p")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each id in links (a, b): the smallest id that links reach.

    Star contraction: every node takes the smallest of its neighbours and itself as its parent,
    chains of parents are followed to their ends, and the graph of the ends is done likewise until it
    has no link left. Each round at least halves what is linked. Links with a null end and loops
    do no harm; the former are left out.
    """
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    alone = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    labels = written(alone.select("id", F.col("id").alias("component")), "labels")
    live = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = _to_roots(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("p")))
        moved = labels.join(star.withColumnRenamed("id", "component"), "component", "left")
        labels = written(moved.select("id", F.coalesce("p", "component").alias("component")), "labels")
        ends = live.join(star.select(F.col("id").alias("a"), F.col("p").alias("x")), "a").join(star.select(F.col("id").alias("b"), F.col("p").alias("y")), "b")
        live = written(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    return labels


def _cells(rows: DataFrame, start: str, stop: str, cell: int) -> DataFrame:
    """A row for each cell of the source that a range touches."""
    last = F.greatest(F.col(start), F.col(stop) - 1)
    return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(last / cell))))


def overlap_links(rows: DataFrame, group: list[str], start: str, stop: str, id: str, cell: int = 10_000) -> DataFrame:
    """Links (a, b) that join ids of one group whose ranges [start, stop) overlap, directly or by
    others between them. A range that holds nothing counts as its first place.

    Equal ranges are put together first; the others are swept in order, cell by cell of the
    source, so that no task has to see a whole file."""
    own = rows.select(*group, F.col(start).cast("long").alias("_s"), F.greatest(F.col(stop), F.col(start) + 1).cast("long").alias("_e"), F.col(id).alias("_id"))
    place = [*group, "_s", "_e"]
    ranges = own.groupBy(*place).agg(F.min("_id").alias("_m"))
    null_safe = [own[c].eqNullSafe(ranges[c]) for c in place]
    same = own.join(ranges, null_safe).select(own["_id"].alias("a"), ranges["_m"].alias("b")).where("a <> b")
    order = Window.partitionBy(*group, "_cell").orderBy("_s", "_e", "_m").rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max(F.struct("_e", "_m")).over(order)
    swept = _cells(ranges, "_s", "_e", cell).select("_s", F.col("_m").alias("a"), furthest.alias("f")).where("_s < f._e")
    return same.unionByName(swept.select("a", F.col("f._m").alias("b")).distinct())


def assemble(candidates: DataFrame, keys: list[str], across_files: bool = False, cell: int = 10_000) -> DataFrame:
    """candidates (file_id, start, stop, field, value, keys, ...) with candidate, document, entry,
    keyed and reason, a row for each different candidate.

    document and entry are ids that candidates of one document, or entry, share; keyed, whether
    its document has a key; reason: "overlaps several documents" or "no business key" for
    those that stay apart. A null file_id, start or stop is a file, or the place 0, of its own
    kind; repeated rows are one candidate. An empty table gives no rows.
    """
    if not keys:
        raise ValueError("documents are told apart by at least one key")
    names = [c for c in candidates.columns if c not in ("candidate", "document", "entry", "keyed", "reason")]
    own = candidates.select(*names).distinct()
    own = own.withColumn("candidate", F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})))
    own = own.withColumn("_s", F.coalesce(F.col("start").cast("long"), F.lit(0))).withColumn("_e", F.coalesce(F.col("stop").cast("long"), F.col("_s") + 1))
    own = written(own.withColumn("_has", F.greatest(*(F.col(k).isNotNull().cast("int") for k in keys), F.lit(0)) == 1), "candidates")
    links = own.select(F.col("candidate").alias("a"), F.col("candidate").alias("b"))
    for k in keys:
        scope = [] if across_files else [F.col("file_id").cast("string")]
        hub = F.md5(F.to_json(F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v"), *scope), {"ignoreNullFields": "false"}))
        # ids of keys come after those of candidates, so that a document's smallest id is a candidate
        links = links.unionByName(own.where(F.col(k).isNotNull()).select(F.col("candidate").alias("a"), F.concat(F.lit("~"), hub).alias("b")))
    links = links.unionByName(overlap_links(own.where("NOT _has"), ["file_id"], "_s", "_e", "candidate", cell))
    group = components(links).withColumnRenamed("id", "candidate").withColumnRenamed("component", "_group")
    own = written(own.join(group, "candidate"), "groups")
    # which documents a keyless group overlaps: pairs are made by cells of one file, of distinct ranges only
    less = own.where("NOT _has").select("file_id", "_s", "_e", "_group").distinct()
    more = own.where("_has").select(F.col("file_id").alias("_f"), F.col("_s").alias("_s2"), F.greatest(F.col("_e"), F.col("_s") + 1).alias("_e2"), F.col("_group").alias("_doc")).distinct()
    less = _cells(less.withColumn("_e", F.greatest(F.col("_e"), F.col("_s") + 1)), "_s", "_e", cell)
    more = _cells(more, "_s2", "_e2", cell).withColumnRenamed("_cell", "_c")
    meet = F.col("file_id").eqNullSafe(F.col("_f")) & (F.col("_cell") == F.col("_c")) & (F.col("_s") < F.col("_e2")) & (F.col("_s2") < F.col("_e"))
    met = less.join(more, meet).groupBy("_group").agg(F.min("_doc").alias("_least"), F.max("_doc").alias("_most"))
    own = own.join(met, "_group", "left")
    one = F.col("_least") == F.col("_most")
    own = own.withColumn("document", F.when(~F.col("_has") & one, F.col("_least")).otherwise(F.col("_group")))
    own = own.withColumn("keyed", F.col("_has") | F.coalesce(one, F.lit(False)))
    reason = F.when(F.col("keyed"), F.lit(None)).when(F.col("_least").isNotNull(), "overlaps several documents").otherwise("no business key")
    own = written(own.withColumn("reason", reason).drop("_group", "_least", "_most"), "documents")
    links = own.select(F.col("candidate").alias("a"), F.col("candidate").alias("b"))
    entries = components(links.unionByName(overlap_links(own, ["document", "file_id", "field"], "_s", "_e", "candidate", cell)))
    return own.join(entries.select(F.col("id").alias("candidate"), F.col("component").alias("entry")), "candidate").select(*names, "candidate", "document", "entry", "keyed", "reason")


def entries_of(assembled: DataFrame) -> DataFrame:
    """(document, entry, file_id, field, start, stop, values, n_met, conflict, keyed, reason): an
    entry with the different values that were read for it, sorted; more than one contradict each other."""
    return assembled.groupBy("document", "entry").agg(
        F.min("file_id").alias("file_id"), F.min("field").alias("field"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.sort_array(F.collect_set("value")).alias("values"), F.count("*").alias("n_met"), (F.min("value") != F.max("value")).alias("conflict"),
        F.first("keyed").alias("keyed"), F.min("reason").alias("reason"),
    )


def document_conflicts(assembled: DataFrame, single: list[str]) -> DataFrame:
    """(document, field, values) of fields that a document has once, such as its date, where values
    that differ were read, in whatever places and files. Sets are made for those alone."""
    own = assembled.where(F.col("field").isin(*single) & F.col("value").isNotNull())
    bad = own.groupBy("document", "field").agg(F.min("value").alias("_a"), F.max("value").alias("_z")).where("_a <> _z").select("document", "field")
    return own.join(bad, ["document", "field"], "left_semi").groupBy("document", "field").agg(F.sort_array(F.collect_set("value")).alias("values"))


def retry_units(assembled: DataFrame) -> DataFrame:
    """(file_id, unit): files that share a document, directly or by other files, are tried again
    together; a unit's name is its smallest file_id."""
    own = assembled.where("file_id IS NOT NULL").select("document", F.col("file_id").cast("string").alias("file_id")).distinct()
    first = own.groupBy("document").agg(F.min("file_id").alias("b"))
    links = own.join(first, "document").select(F.col("file_id").alias("a"), "b")
    return components(links).select(F.col("id").alias("file_id"), F.col("component").alias("unit"))


def unit_targets(assembled: DataFrame, review: DataFrame) -> DataFrame:
    """(file_id, unit): all files of each unit of which a file is under review."""
    units = written(retry_units(assembled), "units")
    bad: Column = F.col("file_id")
    asked = units.join(review.select(bad.cast("string").alias("file_id")).distinct(), "file_id", "left_semi").select("unit").distinct()
    return units.join(asked, "unit", "left_semi").select("file_id", "unit")
