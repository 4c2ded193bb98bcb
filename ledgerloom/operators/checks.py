"""Checks on extracted records, their reasons, and routing to ledger or review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def voucher_balance(entries: DataFrame, keys: list[str], debit: str, credit: str, tol: str = "0") -> DataFrame:
    """Debit and credit totals of each voucher, currency and unit (keys, the voucher's first); never
    across those. Entries without a voucher are of none together, and have no balance."""
    known = entries.where(F.col(keys[0]).isNotNull())
    sums = known.groupBy(*keys).agg(F.coalesce(F.sum(debit), F.lit(0)).alias("debit"), F.coalesce(F.sum(credit), F.lit(0)).alias("credit"))
    diff = F.col("debit") - F.col("credit")
    return sums.withColumn("diff", diff).withColumn("balanced", F.abs(diff) <= F.lit(tol).cast("decimal(18,2)"))


def header_conflict(entries: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, field, values) for each header field with more than one value; nulls are no values,
    and entries without a key contradict nothing. The smallest and the largest value tell which
    are in conflict; sets are made for those alone."""
    known = entries.where(F.col(key).isNotNull()).select(key, *(F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)))
    ends = known.groupBy(key).agg(*(f(f"v{i}").alias(f"{n}{i}") for i in range(len(cols)) for f, n in ((F.min, "a"), (F.max, "z"))))
    differ = F.array_compact(F.array(*(F.when(F.col(f"a{i}") != F.col(f"z{i}"), F.lit(i)) for i in range(len(cols)))))
    bad = ends.select(key, differ.alias("bad")).where(F.size("bad") > 0)
    values = F.array(*(F.col(f"v{i}") for i in range(len(cols))))
    each = known.join(bad, key).select(key, F.explode(F.transform("bad", lambda i: F.struct(F.get(F.array(*map(F.lit, cols)), i).alias("field"), F.get(values, i).alias("v")))).alias("x"))
    return each.groupBy(key, "x.field").agg(F.array_join(F.sort_array(F.collect_set("x.v")), ",").alias("values"))


def amount_relation(items: DataFrame, headers: DataFrame, key: str, amount: str, total: str, tol: str = "0", quantity: str | None = None, price: str | None = None) -> DataFrame:
    """(key, stated, summed, n_bad_items, agrees, reasons) of each header: the items' sum beside
    the stated total, and the number of items whose quantity times price isn't their amount. No
    stated total agrees with anything; a stated one without items doesn't."""
    most = F.lit(tol).cast("decimal(18,2)")
    off = F.lit(False) if quantity is None else F.coalesce(F.abs(F.col(quantity) * F.col(price) - F.col(amount)) > most, F.lit(False))
    sums = items.groupBy(key).agg(F.sum(amount).alias("summed"), F.count_if(off).alias("n_bad_items"))
    out = headers.select(key, F.col(total).alias("stated")).join(sums, key, "left").withColumn("n_bad_items", F.coalesce("n_bad_items", F.lit(0)))
    agrees = F.col("stated").isNull() | F.coalesce(F.abs(F.col("stated") - F.col("summed")) <= most, F.lit(False))
    out = out.withColumn("agrees", agrees)
    reasons = [
        F.when(~F.col("agrees") & F.col("summed").isNull(), F.lit("total without items")),
        F.when(~F.col("agrees") & F.col("summed").isNotNull(), F.lit("items differ from total")),
        F.when(F.col("n_bad_items") > 0, F.lit("quantity x price differs from amount")),
    ]
    return out.withColumn("reasons", F.array_compact(F.array(*reasons)))


def location_exists(results: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose cited position is not among the blocks, with the reason."""
    return results.join(blocks.select(*keys).distinct(), keys, "left_anti").withColumn("reason", F.lit("position not in the source"))


def collect_reasons(checks: DataFrame, record: str, reason: str) -> DataFrame:
    """All reasons of each record, distinct and sorted, in one text."""
    return checks.where(F.col(reason).isNotNull()).groupBy(record).agg(F.array_join(F.sort_array(F.collect_set(reason)), ";").alias("reasons"))


def split_review(checked: DataFrame, reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(normal, review): each row goes to exactly one; null reasons count as none."""
    fine = F.coalesce(F.size(reasons) == 0, F.lit(True))
    return checked.where(fine), checked.where(~fine)


def routed(checked: DataFrame, reasons: str = "reasons") -> DataFrame:
    """checked with route: normal or review."""
    return checked.withColumn("route", F.when(F.coalesce(F.size(reasons), F.lit(0)) == 0, "normal").otherwise("review"))


def failed_file_rows(files: DataFrame, file: str, failed: Column, cause: Column) -> DataFrame:
    """One review row for each file that could not be opened; it holds no document."""
    bad = files.where(failed).groupBy(F.col(file).alias("file_id")).agg(F.min(cause).alias("reason"))
    return bad.withColumn("route", F.lit("review")).withColumn("n_documents", F.lit(0))


def capacity_check(records: DataFrame, row_id: str, fields: list[str], max_chars: int = 32767, max_digits: int = 15) -> DataFrame:
    """(row_id, field, size) of each value that a cell can't hold: too many characters, or a
    number of too many digits. Nothing is cut or rounded."""
    kinds = dict(records.dtypes)

    def size(c: str) -> tuple[Column, int]:
        if kinds[c] == "string":
            return F.length(c), max_chars
        return F.length(F.regexp_replace(F.col(c).cast("string"), "[^0-9]", "")), max_digits

    cells = F.array(*(F.struct(F.lit(c).alias("field"), size(c)[0].cast("long").alias("size"), F.lit(size(c)[1]).alias("most")) for c in fields))
    return records.select(F.col(row_id).alias("row_id"), F.explode(cells).alias("x")).where("x.size > x.most").select("row_id", "x.field", "x.size")


def stop_if_any(violations: DataFrame, what: str) -> None:
    """Stops an export that can't be done whole."""
    if found := violations.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def required_fields(records: DataFrame, statuses: dict[str, Column]) -> DataFrame:
    """records with reasons (fields that can't be read) and notes (fields that are not stated)."""
    reasons = [F.when(s == "unreadable", F.lit(f"unreadable {f}")) for f, s in statuses.items()]
    notes = [F.when(s == "not_stated", F.lit(f"not stated: {f}")) for f, s in statuses.items()]
    return records.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("notes", F.array_compact(F.array(*notes)))


def assemble_documents(candidates: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Candidates of one document put together: content, the values at each position in order
    (more than one value: they contradict each other), n_candidates, the number of distinct
    (position, value) pairs (overlapping fragments repeat them), and conflict, whether any
    position has two values. Rows with a null key stay apart, each by its position, for review."""
    salt = F.when(F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 1, F.col(position))
    each = candidates.withColumn("_apart", salt).groupBy(*keys, "_apart", F.col(position).alias("_at")).agg(F.sort_array(F.collect_set(value)).alias("_v"))
    part = F.struct(F.col("_at").alias("position"), F.col("_v").alias("values"))
    return each.groupBy(*keys, "_apart").agg(
        F.array_sort(F.collect_list(part)).alias("content"), F.sum(F.size("_v")).alias("n_candidates"), F.max(F.size("_v") > 1).alias("conflict")
    ).drop("_apart")
