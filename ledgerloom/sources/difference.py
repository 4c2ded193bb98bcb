"""Which rows two tables differ in, by a tree of checksums.

Rows are dealt to branches by the leading bits of a hash, of their key columns or of all of them.
Per level only counts and sums of a branch are compared, a few rows a task; only branches that
differ are looked into further. Rows are shuffled of the last unequal branches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 8  # bits of a level
MOST = 4096  # unequal branches up to which it is worth while to look further


def row_digest(df: DataFrame) -> Column:
    """A number for each row by its values, whatever the order of columns."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))).cast("decimal(38,0)")


def _signed(expected: DataFrame, actual: DataFrame, keys: list[str] | None) -> DataFrame:
    """(b, sign, d, row) of all rows: b the bits of their branch, most significant first."""

    def one(df: DataFrame, sign: int) -> DataFrame:
        # another hash than the digest, so that equal bits say nothing about equal sums
        by = F.xxhash64(F.lit(7), *(F.col(f"`{c}`") for c in (keys or sorted(df.columns))))
        own = F.struct(*(F.col(f"`{c}`") for c in expected.columns))
        return df.select(by.alias("b"), F.lit(sign).alias("sign"), row_digest(df).alias("d"), own.alias("row"))

    return one(expected, 1).unionByName(one(actual, -1))


def _branch(bits: int) -> Column:
    return F.shiftrightunsigned("b", 64 - bits)


def unequal_branches(expected: DataFrame, actual: DataFrame, keys: list[str] | None = None, leaf: int = 1000) -> tuple[int, list[int]]:
    """(bits, branches of so many bits that differ): none where the tables are equal; branches are
    looked into until they hold about `leaf` rows. Two scans a level, and no row is shuffled."""
    if sorted(expected.columns) != sorted(actual.columns):
        raise ValueError("the tables have different columns")
    rows = _signed(expected, actual, keys).select("b", "sign", "d")
    changed = (F.sum(F.col("sign")).alias("n"), F.sum(F.col("sign") * F.col("d")).alias("s"))
    whole = rows.agg(*changed, F.count("*").alias("all")).first()
    if not whole["n"] and not whole["s"]:
        return 0, []
    bits, bad = 0, [0]
    while whole["all"] > 2 * leaf << bits and len(bad) <= MOST and bits + LEVEL < 64:
        inside = rows if not bits else rows.where(_branch(bits).isin(bad))
        bits += LEVEL
        bad = [r.k for r in inside.groupBy(_branch(bits).alias("k")).agg(*changed).where("n <> 0 OR s <> 0").select("k").collect()]  # at most MOST << LEVEL numbers
    return bits, bad


def differences(expected: DataFrame, actual: DataFrame, keys: list[str] | None = None, leaf: int = 1000) -> DataFrame:
    """(side, times, columns of expected): rows that stand more often on one side, "expected" or
    "actual", and how much more often. Columns are compared by name; a null equals a null. With
    keys, which needn't be unique, a changed row's two forms lie in one branch."""
    bits, bad = unequal_branches(expected, actual, keys, leaf)
    rows = _signed(expected, actual, keys)
    if not bad:
        rows = rows.limit(0)
    elif bits and len(bad) <= MOST:
        rows = rows.where(_branch(bits).isin(bad))
    elif bits:  # much is different: branches say where, as a table
        rows = rows.join(expected.sparkSession.createDataFrame([(k,) for k in bad], "k long"), _branch(bits) == F.col("k"), "left_semi")
    left = rows.groupBy("b", "row").agg(F.sum("sign").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, "expected").otherwise("actual")
    return left.select(side.alias("side"), F.abs("n").cast("long").alias("times"), "row.*")
