"""The voucher job: entries with their headers, balance and conflict checks, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import header_conflict, routed, voucher_balance
from ..operators.ledgers import one_header, voucher_ledger


def voucher_job(headers: DataFrame, entries: DataFrame, key: str, header_fields: list[str]) -> DataFrame:
    """headers (key, ...) and entries (key, currency, unit, debit, credit, header fields, ...):
    a row for each entry, with its voucher's reasons and route; an entry without a header goes
    to review, as all entries of a voucher whose headers contradict each other do. Entries are dealt
    out by key once: balance, conflicts and both joins use that. Those without a key take no
    part in it, however many they are."""
    known = entries.where(F.col(key).isNotNull()).repartition(key)
    unbalanced = voucher_balance(known, [key, "currency", "unit"], "debit", "credit").where("NOT balanced")
    unbalanced = unbalanced.select(key, F.lit("unbalanced").alias("reason"))
    conflicts = header_conflict(known, key, header_fields).select(key, F.concat(F.lit("conflict in "), "field").alias("reason"))
    several = one_header(headers, key).where("header_differs").select(key, F.lit("several headers").alias("reason"))
    reasons = unbalanced.unionByName(conflicts).unionByName(several).groupBy(key).agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    rows = voucher_ledger(headers, known, key).join(reasons, key, "left")
    nothing = {c: t for c, t in rows.dtypes if c not in entries.columns and c not in ("header_found", "reasons")}
    keyless = entries.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), F.lit(False).alias("header_found"))
    rows = rows.unionByName(keyless, allowMissingColumns=True)
    none = F.array().cast("array<string>")
    alone = F.when(F.col("header_found"), none).otherwise(F.array(F.lit("no header")))
    return routed(rows.withColumn("reasons", F.concat(alone, F.coalesce("reasons", none))).drop("header_found"))
