"""Work on rows in order, without a task that sees all rows of a file.

Only keys and small values are sorted, split by ranges and written down once; what is found for
each place goes back to its row by a join. Texts are shuffled once, for that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written


def n_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_hash(df: DataFrame) -> Column:
    """A hash that tells rows of equal keys apart, unless they are equal in all columns (maps by their entries)."""
    kinds = dict(df.dtypes)
    return F.xxhash64(*(F.to_json(F.struct(F.sort_array(F.map_entries(c)))) if kinds[c].startswith("map") else F.col(f"`{c}`") for c in df.columns))


def placed(df: DataFrame, keys: list[str], parts: int | None = None, **values: Column) -> DataFrame:
    """(k0, k1, ..., h, occ, values, part) of each row of df: sorted by keys and h into parts by
    ranges, and written down. Equal rows are told apart by occ, from 1."""
    own = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), row_hash(df).alias("h"), *(v.alias(n) for n, v in values.items()))
    names = [f"k{i}" for i in range(len(keys))]
    each = own.groupBy(*names, "h").agg(F.count("*").alias("m"), *(F.first(n).alias(n) for n in values))
    each = each.select(*names, "h", *values, F.explode(F.sequence(F.lit(1), F.col("m"))).alias("occ"))
    return written(each.repartitionByRange(parts or n_parts(df), *names, "h", "occ").withColumn("part", F.spark_partition_id()), "places")


def given_back(df: DataFrame, keys: list[str], found: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns that found (k0, ..., h, columns) has for each of its rows, one for each
    of equal rows; columns of df of these names are replaced."""
    names = [f"k{i}" for i in range(len(keys))]
    kept = [c for c in df.columns if c not in columns]
    # equal rows are one here; each place that was found for them makes a row of it again
    rows = df.select(*(F.col(c).alias(f"r{i}") for i, c in enumerate(keys)), row_hash(df).alias("rh"), F.struct(*df.columns).alias("row")).dropDuplicates([*(f"r{i}" for i in range(len(keys))), "rh"])
    same = F.col("h") == F.col("rh")
    for i in range(len(keys)):
        same = same & F.col(f"k{i}").eqNullSafe(F.col(f"r{i}"))
    out = rows.join(found.select(*names, "h", *columns), same)
    return out.select(*(F.col("row")[c].alias(c) for c in kept), *columns)
