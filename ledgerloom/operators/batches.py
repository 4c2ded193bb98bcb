"""Batches: intake, resume, retry, numbering and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.positions import given_back, placed

#: Fields of a ledger without a template, by type of document.
DEFAULT_FIELDS = {
    "invoice": ("invoice_no", "taxpayer_no", "currency", "unit", "total", "items"),
    "voucher": ("org", "voucher_no", "voucher_date", "account", "currency", "unit", "debit", "credit"),
    "contract": ("contract_no", "name", "party_a", "party_b", "total", "condition_lines", "share_lines", "due_lines"),
    "minutes": ("topic_no", "topic", "resolution", "task", "owner", "due"),
}
#: Names of the columns that an export adds.
PROVENANCE = ("source_file", "source_position", "item_no", "note", "review_reason")


def dedupe_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """The same path chosen twice counts once."""
    clean = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "(?<!:)/{2,}", "/")
    return files.withColumn(path, clean).dropDuplicates([path])


def dedupe_content(files: DataFrame, sha: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(kept, merged): of equal contents the smallest path stays; merged tells for each other
    which one stands for it. Only hashes and paths are shuffled, pre-aggregated."""
    first = files.groupBy(sha).agg(F.min(path).alias("kept_as"))
    both = files.select(sha, path).join(first, sha)
    return first.select(sha, F.col("kept_as").alias(path)), both.where(F.col(path) != F.col("kept_as"))


def pending_files(files: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    return files.join(saved.select(*keys).distinct(), keys, "left_anti")


def source_drift(saved: DataFrame, current: DataFrame, path: str, sha: str) -> DataFrame:
    """(path, state): same, changed, missing or new."""
    a, b = saved.select(path, F.col(sha).alias("_a")), current.select(path, F.col(sha).alias("_b"))
    both = a.withColumn("_in_a", F.lit(True)).join(b.withColumn("_in_b", F.lit(True)), path, "full_outer")
    state = F.when(F.col("_in_a").isNull(), "new").when(F.col("_in_b").isNull(), "missing").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return both.select(path, state.alias("state"))


def replace_file_results(saved: DataFrame, retried: DataFrame, retried_files: DataFrame, key: str) -> DataFrame:
    """The retried files' former results give way to the new ones; all others stay."""
    return saved.join(retried_files.select(key).distinct(), key, "left_anti").unionByName(retried)


def retry_targets(files: DataFrame, review: DataFrame, key: str) -> DataFrame:
    return files.join(review.select(key).distinct(), key, "left_semi")


def occupied_rows(positions: DataFrame, existing: DataFrame, row: str = "row_no") -> DataFrame:
    """Target rows that hold something already; any such row must stop the export."""
    return positions.join(existing.select(row).distinct(), row, "left_semi")


def number_items(records: DataFrame, file: str, order: list[Column | str]) -> DataFrame:
    return records.withColumn("item_no", F.row_number().over(Window.partitionBy(file).orderBy(*order)))


def latest_result(attempts: DataFrame, file: str, order: str, cols: list[str]) -> DataFrame:
    """The newest row of each file, of several at one time the largest (partial aggregation, no sort)."""
    newest = F.max_by(F.struct(*cols), F.struct(order, *cols)).alias("x")
    return attempts.groupBy(file).agg(newest).select(file, "x.*")


def row_positions(df: DataFrame, order: list[str], start: int = 1, n: int | None = None) -> DataFrame:
    """df with row_no: start plus each row's place in the order of all rows.

    Keys are range-partitioned and written down; places come from the counts of partitions (one row
    each) and a row number within each partition, so no task sees all rows. Rows equal in order
    are in the order of a hash of their columns.
    """
    keys = [f"k{i}" for i in range(len(order))]
    places = placed(df, order, n)
    sizes = places.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*keys, "h", "occ"))
    found = places.withColumn("rn", within).join(F.broadcast(bases), "part")
    found = found.select(*keys, "h", (F.col("base") + F.col("rn") - 1 + start).alias("row_no"))
    return given_back(df, order, found, ["row_no"])


def source_order(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*order)


def default_fields(records: DataFrame, doc_type: str, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """The type's fields in their order; one that records don't have is an empty column."""
    own = (fields or DEFAULT_FIELDS)[doc_type]
    return records.select(*(F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in own))


def check_template(columns: list[str | None]) -> None:
    """columns: the header at each position, None where a column is empty."""
    names = [c for c in columns if c is not None]
    if any(not c.strip() for c in names) or len(set(names)) != len(names) or set(names) & set(PROVENANCE):
        raise ValueError("template headers must be non-empty, unique and not those of added columns")


def template_fields(records: DataFrame, columns: list[str | None], fields: str = "fields") -> DataFrame:
    """Values by header in the template's positions; an empty column keeps its place (gap_N)."""
    check_template(columns)
    own = [F.lit(None).cast("string").alias(f"gap_{i}") if c is None else F.try_element_at(F.col(fields), F.lit(c)).alias(c) for i, c in enumerate(columns, 1)]
    return records.select(*(c for c in records.columns if c != fields), *own)


def with_provenance(records: DataFrame, source: Column, position: Column, item_no: Column, note: Column) -> DataFrame:
    return records.select("*", source.alias("source_file"), position.alias("source_position"), item_no.alias("item_no"), note.alias("note"))


def batch_summary(results: DataFrame, batch: str, route: str = "route") -> DataFrame:
    return results.groupBy(batch).agg(F.count_if(F.col(route) == "normal").alias("n_normal"), F.count_if(F.col(route) == "review").alias("n_review"))


def progress(latest: DataFrame, stage: str) -> DataFrame:
    return latest.groupBy(stage).agg(F.count("*").alias("n_files"))


def full_batch_view(normal: DataFrame, review: DataFrame) -> DataFrame:
    return normal.withColumn("sheet", F.lit("normal")).unionByName(review.withColumn("sheet", F.lit("review")), allowMissingColumns=True)


def sources_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that stand on one side only: none if nothing changed."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def classify_attempts(attempts: DataFrame, file: str, ts: str, status: str, temporary: tuple[str, ...], done: tuple[str, ...], max_tries: int) -> DataFrame:
    """(file, tries, next_action) by the last status: done, retry (a temporary failure with tries
    left), give_up (without), or stop (any other: trying again can't help)."""
    newest = F.max_by(status, F.struct(ts, status)).alias("last")
    out = attempts.groupBy(file).agg(F.count_if(F.col(status).isin(*temporary)).alias("tries"), newest)
    again = F.when(F.col("tries") < max_tries, "retry").otherwise("give_up")
    action = F.when(F.col("last").isin(*done), "done").when(F.col("last").isin(*temporary), again).otherwise("stop")
    return out.select(file, "tries", action.alias("next_action"))
