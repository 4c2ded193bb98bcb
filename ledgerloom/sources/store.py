"""Saved results, exports and their verification."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .difference import differences, row_digest


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir, or what
    setCheckpointDir was given); a local one only where none is set and both are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: made once, however often it is read, and its lineage ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, n_bytes: int = 4 << 20) -> None:
    """Lowers the session's bound on an Arrow batch to n_bytes, where it is higher: by default
    a task passes up to 10,000 rows to Python at once, contents of files or whole texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864b").rstrip("b")) > n_bytes:
        spark.conf.set(key, str(n_bytes))


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch made, by the store's own interface."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_ledger(normal: DataFrame, review: DataFrame, out_dir: str, run_id: str, fmt: str = "parquet") -> list[str]:
    """Writes both tables of a run as a new output; an existing run is never overwritten. Each is
    made once: its checksum is taken while it is written. Only when both have been read back and
    found equal is the run marked as finished; rows that differ are named in the error."""
    paths, counts = [], []
    for name, df in (("normal", normal), ("review", review)):
        path = f"{out_dir}/{name}/run_id={run_id}"
        seen = Observation()
        out = df.observe(seen, *_sums(df)).write.mode("errorifexists")
        if fmt == "csv":
            # keeps null and '' apart
            out = out.options(header=True, nullValue="\\N", emptyValue='""', escape='"')
        out.format(fmt).save(path)
        back = read_csv_ledger(df.sparkSession, path, df.schema) if fmt == "csv" else df.sparkSession.read.schema(df.schema).parquet(path)
        held = checksum(back).first()
        if (held.n, held.sum) != (seen.get["n"], seen.get["sum"]):
            rows = [r.asDict() for r in differences(df, back).limit(5).collect()]
            raise ValueError(f"{path} doesn't hold what was written: {rows}")
        paths.append(path)
        counts.append(held.n)
    mark = normal.sparkSession.createDataFrame([tuple(counts)], "n_normal long, n_review long")
    mark.coalesce(1).write.mode("errorifexists").parquet(f"{out_dir}/finished/run_id={run_id}")
    return paths


def read_csv_ledger(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(header=True, nullValue="\\N", emptyValue="", escape='"', multiLine=True).csv(path)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))


def save_results(results: DataFrame, store: str, buckets: int = 32) -> None:
    """Saves results (batch_id, file_id, ...) with their review reasons by batch and bucket of
    file; only the buckets that results touch are replaced, so pass those buckets whole."""
    out = _bucketed(results if "present" in results.columns else results.withColumn("present", F.lit(True)), buckets)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(store)


def saved_results(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).where("present").drop("present", "bucket")


def replace_results(files: DataFrame, again: DataFrame, store: str, buckets: int = 32) -> None:
    """The results of files (batch_id, file_id) give way to again (of the same columns as those
    saved), all others stay. A file that has no results now leaves a row that isn't present,
    so its bucket is written over even if nothing else is in it."""
    spark, key = files.sparkSession, ["batch_id", "file_id"]
    files = files.select(*key).distinct()
    touched = _bucketed(files, buckets).select("batch_id", "bucket").distinct()
    saved = spark.read.parquet(store)
    # whatever it cost to make, it is made once
    once = scratch(spark, "again")
    again.write.parquet(once)
    again = spark.read.schema(again.schema).parquet(once)
    kept = saved.join(touched, ["batch_id", "bucket"], "left_semi").drop("bucket").join(files, key, "left_anti")
    none = files.join(again.select(*key).distinct(), key, "left_anti").withColumn("present", F.lit(False))
    out = kept.unionByName(again.withColumn("present", F.lit(True))).unionByName(none, allowMissingColumns=True)
    aside = scratch(spark, "replaced")  # a table can't be read and written over at once
    out.write.parquet(aside)
    save_results(spark.read.schema(out.schema).parquet(aside), store, buckets)
    drop_folder(spark, once)
    drop_folder(spark, aside)


def _sums(df: DataFrame) -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_digest(df)), F.lit(0).cast("decimal(38,0)")).alias("sum")


def checksum(df: DataFrame) -> DataFrame:
    """(n, sum): a fingerprint of the rows as a multiset, whatever their order."""
    return df.agg(*_sums(df))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(check, expected, actual, ok) for the number of rows and for their fingerprint."""
    both = checksum(expected).select(F.col("n").alias("n1"), F.col("sum").alias("s1")).join(checksum(actual).select(F.col("n").alias("n2"), F.col("sum").alias("s2")))
    row = F.explode(F.array(
        F.struct(F.lit("rows").alias("check"), F.col("n1").cast("string").alias("expected"), F.col("n2").cast("string").alias("actual")),
        F.struct(F.lit("content").alias("check"), F.col("s1").cast("string").alias("expected"), F.col("s2").cast("string").alias("actual")),
    ))
    return both.select(row.alias("r")).select("r.*").withColumn("ok", F.col("expected") == F.col("actual"))


def verify_export(expected: DataFrame, path: str) -> DataFrame:
    return verify(expected, expected.sparkSession.read.schema(expected.schema).parquet(path))


def latest(df: DataFrame, run: str = "run_id") -> DataFrame:
    """The rows of the newest run."""
    return df.join(df.agg(F.max(run).alias(run)), run, "left_semi")


def latest_export(spark: SparkSession, out_dir: str, table: str = "normal") -> DataFrame:
    """The table of the newest finished run; runs that were broken off don't count."""
    run = spark.read.parquet(f"{out_dir}/finished").agg(F.max("run_id")).first()[0]
    return spark.read.parquet(f"{out_dir}/{table}/run_id={run}").withColumn("run_id", F.lit(run))
