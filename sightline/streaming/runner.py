"""Runs a stream over what is there now, and gives its result as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sightline.streaming.landing import committed, keep


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, else the warehouse; a temporary one on a local master, where all is one machine. A warehouse that is each machine's own is refused on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if root is None and master.startswith("local") and not master.startswith("local-cluster"):
        root = tempfile.mkdtemp(prefix="sightline-")
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if root.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def events(spark: SparkSession, sf_dir: str, name: str, files: int = 4) -> DataFrame:
    """A table of the driver, one file or a folder, as a stream of its files. The last letter is a pattern, since a plain path would have to be a folder."""
    kind = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def finished(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The stream's result once all its input is read: in complete mode the last batch's, in append mode that of all batches. A batch that is run again replaces its own rows."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    stream.writeStream.foreachBatch(keep(f"{path}/out", latest=mode == "complete")).outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return committed(spark, f"{path}/out", stream.schema)
