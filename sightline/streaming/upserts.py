"""Facts from streams: windowed counts with late rows, best readings kept as state, and the confidence-guarded upsert batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.facts import KEY, upsert


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Counts and sums per key and tumbling window; rows later than `late` behind the newest are dropped."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def replayed(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Captured frames as a stream, some files a trigger, the oldest first: what a device would have shown, again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(path)


def best_readings(facts: DataFrame, late: str | None = None, key: list[str] = KEY) -> DataFrame:
    """The upsert as a running aggregation: of one key, the reading that came first with the highest confidence, and its first arrival. For output modes update and complete.

    late: how far behind the newest observation readings still count. A key names the day it was observed, so its state goes once the watermark has passed that
    day; without `late` state grows for ever.
    """
    if late is None:
        return upsert(facts, key).drop("reads")
    timed = facts.withColumn("observed_ts", F.to_timestamp("observed_at")).withWatermark("observed_ts", late)
    return upsert(timed, [*key, "observed_ts"]).drop("reads")


def newest_of(batches: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The last state of each key, from all batches of a stream in update mode, each row with its batch number as `batch`."""
    return batches.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batches.columns if c not in (*key, "batch")]), "batch").alias("_s")).select(*key, "_s.*")


def upsert_into(spark: SparkSession, path: str, buckets: int = 64):
    """foreachBatch function: merges a batch of facts into a table under path, kept in buckets of keys.

    A batch rewrites only the buckets that its keys fall in, each as a new
    version of that bucket, and then commits by a manifest that names the version of every bucket. A batch that is run again after a
    failure starts from the manifest before it, so it writes the same rows anew; half-written versions are named by no manifest and never read.
    Rows carry arrival and fact_id, so ties go to the earliest and the first arrival's id survives.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if "fact_id" not in batch.columns:
            batch = batch.withColumn("fact_id", F.col("arrival"))
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
        hit = [r.bucket for r in batch.select("bucket").distinct().collect()]  # `buckets` rows at the most
        known = manifest(spark, path, batch_id)
        rows = batch
        paths = [f"{path}/bucket={b}/v={known[b]}" for b in hit if b in known]
        if paths:
            old = spark.read.option("basePath", path).parquet(*paths).drop("v")
            rows = batch.unionByName(old.select(*batch.columns))
        first = rows.groupBy(*KEY).agg(F.min("fact_id").alias("_id"))
        merged = upsert(rows.drop("fact_id")).drop("fact_id", "reads").join(first, KEY).withColumnRenamed("_id", "fact_id")
        merged.withColumn("v", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(path)
        named = {**known, **dict.fromkeys(hit, batch_id)}
        spark.createDataFrame(sorted(named.items()), "bucket int, v long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/{batch_id:012d}")

    return run


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Version of each bucket by the newest manifest that was committed (before a batch, if one is named)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return {}
    done = sorted(int(s.getPath().getName()) for s in fs.listStatus(hadoop) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    done = [n for n in done if before is None or n < before]
    return {r.bucket: r.v for r in spark.read.parquet(f"{path}/_manifest/{done[-1]:012d}").collect()} if done else {}  # one row a bucket


def current(spark: SparkSession, path: str) -> DataFrame:
    """The facts as the newest manifest has them."""
    named = manifest(spark, path)
    if not named:
        raise LookupError(f"no committed batch under {path}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/bucket={b}/v={v}" for b, v in sorted(named.items())]).drop("bucket", "v")


__all__ = ["KEY", "best_readings", "current", "manifest", "newest_of", "replayed", "upsert_into", "windowed_counts"]
