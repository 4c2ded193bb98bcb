"""Contiguous shards of near equal bytes (operator 9): DataFrame operations only.

Rows are range-partitioned by id. Sizes are summed within each partition, and the partition
totals (one row a partition) give each partition's base, so no window runs over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle


def byte_shards(rows: DataFrame, order: list[str], size: str, n_shards: int) -> DataFrame:
    """rows with shard (0 to n_shards - 1) and slot (place in its shard, from 0); columns of
    these names are replaced, all others kept, whatever their names.

    A row goes to the shard in whose equal part of all bytes its middle lies, so each shard
    is within one row's size of its share; shards follow the order of the columns in order
    (nulls first; rows equal in all of them are interchangeable). A null size counts as 0. A
    table without rows gives none. A shard may be empty only if one row is larger than a share.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    bytes_ = F.coalesce(F.col(size).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    own = rows.select(F.struct(*rows.columns).alias("row"), bytes_.alias("bytes"))
    order = [F.col("row")[c] for c in order]
    # written down, so that what a partition holds stays the same when a task runs again
    placed = settle(own.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), zero).alias("byte_base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_base"),
        F.sum("bytes").over(everything).alias("all"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    run = placed.withColumn("end", F.sum("bytes").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(within))
    # one row a partition
    run = run.join(F.broadcast(bases), "part")
    middle = 2 * (F.col("byte_base") + F.col("end")) - F.col("bytes")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.greatest(2 * F.col("all"), F.lit(1))).cast("int"))
    run = run.select("row", shard.alias("shard"), (F.col("row_base") + F.col("rn") - 1).alias("index"))
    # one row a shard
    firsts = run.groupBy("shard").agg(F.min("index").alias("first"))
    out = run.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("index") - F.col("first"))
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "shard", "slot")
