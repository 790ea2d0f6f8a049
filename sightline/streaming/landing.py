"""A durable queue between capture and ingest: captures land as files, a stream takes each once, and its results are kept under the number of their batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    """The folder as Hadoop sees it, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder whose writing was completed, in order; a write in progress or broken off has none of Spark's marks and isn't among them."""
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return []
    done = [s.getPath() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(p.getName() for p in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def land(captures: DataFrame, queue: str, files: int | None = None) -> str:
    """Puts captures at the end of the queue, in a folder of their own (of so many files) that Spark's commit publishes whole. One writer lands at a time."""
    spark = captures.sparkSession
    done = folders(spark, queue)
    path = f"{queue}/{int(done[-1]) + 1 if done else 0:012d}"
    (captures.repartition(files) if files else captures).write.mode("overwrite").parquet(path)
    return path


def landed(spark: SparkSession, queue: str, schema: StructType | str, files: int | None = None) -> DataFrame:
    """The queue as a stream, the oldest first; a trigger takes what has landed since the last, or at the most so many files."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(f"{queue}/*")


def keep(path: str, prepare: Callable[[DataFrame, int], DataFrame] | None = None, latest: bool = False) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: a batch's rows go to a folder under the batch's number, which they replace.

    A batch that is run again after a failure has the same number and the same input, so it leaves one set of rows; what a broken write has left isn't read.
    latest: folders of earlier batches are removed, for results that are whole each time.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        (prepare(batch, number) if prepare else batch).write.mode("overwrite").parquet(f"{path}/{number:012d}")
        if latest:
            for name in folders(spark, path):
                if int(name) < number:
                    where, fs = _files(spark, f"{path}/{name}")
                    fs.delete(where, True)

    return run


def committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches that were written whole; none if there is none yet."""
    done = folders(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in done])


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], progress: str, mode: str = "append") -> None:
    """Runs a stream until all that has landed is in the sink, then stops. Called again, it goes on where it stopped or broke off."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
