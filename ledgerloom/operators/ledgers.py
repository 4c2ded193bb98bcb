"""Row grains of the ledgers: entries, to-dos, invoices and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positions import row_hash


def one_header(headers: DataFrame, key: str) -> DataFrame:
    """headers with one row for each key (that of the smallest hash) and header_differs: whether
    rows of the key contradict each other. Headers without a key are left out."""
    rest = [c for c in headers.columns if c != key]
    own = headers.where(F.col(key).isNotNull()).select(key, F.struct(*rest).alias("row"), row_hash(headers).alias("h"))
    one = own.groupBy(key).agg(F.min_by("row", "h").alias("row"), (F.min("h") != F.max("h")).alias("header_differs"))
    return one.select(key, *(F.col("row")[c].alias(c) for c in rest), "header_differs")


def voucher_ledger(headers: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """A row for each entry with its voucher's header values and header_found; no summary row. An
    entry without a header, or without a key, stays, its header values null. Several headers of
    one key make no more rows (see one_header)."""
    heads = one_header(headers, key).drop("header_differs").withColumn("header_found", F.lit(True))
    return entries.join(heads, key, "left").withColumn("header_found", F.coalesce("header_found", F.lit(False)))


def minutes_ledger(topics: DataFrame, todos: DataFrame, key: str) -> DataFrame:
    """A row for each to-do; a topic without any stays once, its to-do columns null."""
    return topics.join(todos, key, "left")


def minutes_from_nested(topics: DataFrame, todos: str = "todos") -> DataFrame:
    return topics.select(*(c for c in topics.columns if c != todos), F.explode_outer(todos).alias("todo"))


def attach_evidence(vouchers: DataFrame, attachments: DataFrame, key: str, name: str) -> DataFrame:
    """vouchers with n_attachments and attachments (sorted names, joined); they add no rows."""
    own = attachments.groupBy(key).agg(F.count("*").alias("n_attachments"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("attachments"))
    out = vouchers.join(own, key, "left")
    return out.withColumn("n_attachments", F.coalesce("n_attachments", F.lit(0))).withColumn("attachments", F.coalesce("attachments", F.lit("")))


def ordered(order: list[str], fields: list[str]) -> Column:
    """A group's rows as an array in full order."""
    return F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order))))


def invoice_ledger(headers: DataFrame, items: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """A row for each invoice, its items line by line in one cell (items), in order; the cell of
    an invoice without items is empty."""
    own = items.withColumn("_line", line).groupBy(key).agg(ordered(order, ["_line"]).alias("_items"))
    own = own.select(key, F.array_join(F.transform("_items", lambda x: x["_line"]), "\n").alias("items"))
    return headers.join(own, key, "left").withColumn("items", F.coalesce("items", F.lit("")))


def contract_ledger(contracts: DataFrame, instalments: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """A row for each contract; each field of its instalments as lines, aligned item by item (a
    blank holds its place). A total is never made up."""
    own = instalments.groupBy(key).agg(ordered(order, fields).alias("_i"))

    def lines(f: str) -> Column:
        return F.array_join(F.transform("_i", lambda x: F.coalesce(x[f].cast("string"), F.lit(""))), "\n")

    out = contracts.join(own, key, "left")
    return out.select(*contracts.columns, *(F.coalesce(lines(f), F.lit("")).alias(f"{f}_lines") for f in fields))
