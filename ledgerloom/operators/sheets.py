"""Ledgers cut into sheets that hold a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packing import packed
from ..functions.positions import placed, row_hash
from .checks import stop_if_any


def cut_sheets(ledger: DataFrame, key: str, order: list[str], most: int, start: int = 1) -> DataFrame:
    """ledger with sheet_no (from 1) and row_no (from start) in its sheet; columns of these names
    are replaced.

    Vouchers (rows of one key) follow each other by their first row in the given order, rows
    within one by that order. A sheet takes vouchers until the next one wouldn't fit into its `most`
    rows; none is ever divided, and one of more than `most` rows is an error: nothing is
    cut. A row without a key is a voucher of its own.

    What is sorted is a row for each voucher, in parts that any task works on; rows are only numbered
    within their voucher.
    """
    kept = [c for c in ledger.columns if c not in ("sheet_no", "row_no")]
    at: Column = F.struct(*(F.col(c) for c in order))
    # rows equal in all columns and without a key stay together
    voucher = F.when(F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("r"), row_hash(ledger).cast("string")))
    rows = ledger.select(F.struct(*kept).alias("row"), voucher.alias("v"), at.alias("at"), row_hash(ledger).alias("h"))
    sizes = rows.groupBy("v").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    stop_if_any(sizes.where(F.col("n") > most).select("v", "n"), f"vouchers of more than {most} rows")
    line = sizes.select(F.lit(0).alias("f"), F.struct("first", "v").alias("p"), "n")
    places = placed(line, ["f", "p"], n=F.col("n"))
    cut = packed(places, most).select(F.col("k1.v").alias("v"), "k1", (F.col("frag_no") + 1).alias("sheet_no")).join(sizes.select("v", "n"), "v")
    # a sheet holds at most `most` vouchers
    before = Window.partitionBy("sheet_no").orderBy("k1").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("v", "sheet_no", (F.coalesce(F.sum("n").over(before), F.lit(0)) + start).alias("base"))
    own = Window.partitionBy("v").orderBy("at", "h")
    out = rows.withColumn("i", F.row_number().over(own) - 1).join(cut, "v")
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "sheet_no", (F.col("base") + F.col("i")).alias("row_no"))
