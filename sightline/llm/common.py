"""What the corpus operators share: input, shared scratch tables, worker-side state and text columns."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every contract here: space, and tab to carriage return.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]+"

#: Setting of Spark (from 4.1 on) by which a finished execution removes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: dict[str, list[str]] = {}


def by_value(name: str) -> None:
    """Ship the module's functions inside the tasks, so that workers need no import path to this repository."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def process_cache(key: str, make: Callable, large: bool = False):
    """A value kept for the life of a Python worker, made on first use; functions shipped by value have no module to keep it in. A large one goes when the worker takes up batches of an operator that reads by `slices`."""
    store = sys.modules.setdefault("_sightline_worker_state", types.ModuleType("_sightline_worker_state")).__dict__
    if large:
        store = store.setdefault("large", {})
    if key not in store:
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Returns memory that Arrow and the C library hold but don't use: a worker lives on after its task, beside the workers and the executor that need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        return


def slices(batches, rows: int):
    """Arrow batches in parts of so many rows, so that what Python makes of a batch stays small; at the end unused memory is given back. What other operators keep in the worker that is large goes first."""
    process_cache("large", dict).clear()
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a folder under the warehouse; on a local master, where all is one machine, a temporary one.

    On a cluster a warehouse of scheme `file` is refused, as it would be each machine's own.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return process_cache("local_scratch", lambda: tempfile.mkdtemp(prefix="sightline-"))
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_scratch"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for paths in _made.values():
        for p in paths:
            try:
                _delete(spark, p)
            except Exception:  # noqa: BLE001  the session may be gone at exit
                return


atexit.register(_sweep)


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder and read again.

    A written table cuts lineage: a lost executor costs only tasks of the
    stage at hand. `drop` deletes tables that nothing reads any more; the rest goes when Python exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, str] = {}
        _made.setdefault(self.root, []).append(self.root)

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{tag}"

    def keep(self, df: DataFrame, tag: str, **options) -> DataFrame:
        path = self.path(tag)
        # what this write shuffles is needed by nothing later: its files go at its end, not when the driver next collects garbage
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._scratch_path)

    def clear(self) -> None:
        """Deletes all tables, when nothing reads them any more."""
        _delete(self.spark, self.root)


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most so many rows; decided by its count, not by an estimate."""
    return df.limit(rows + 1).count() <= rows


#: Rows of one or two long columns: 16 MB at the most.
BROADCAST_ROWS = 1_000_000


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose key is among keys (a written table): the keys are broadcast if they are counted to be few, else both sides are shuffled."""
    return df.join(F.broadcast(keys) if fits_broadcast(keys, BROADCAST_ROWS) else keys, on, "left_semi")


def row_key(doc_id: Column, text: Column) -> Column:
    """Stands for a doc_id with its text, so that rows that share a doc_id are told apart; a missing doc_id counts as a value."""
    return F.xxhash64(doc_id, doc_id.isNull(), text)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text are in gone (a written table: doc_id, row of row_key). Other columns may have any names."""
    own = row_key(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))
    few = F.broadcast(gone) if fits_broadcast(gone, BROADCAST_ROWS) else gone
    return docs.join(few, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (own == gone["row"]), "left_anti")


def numbered(df: DataFrame, key: str | list[str], scratch: Scratch) -> DataFrame:
    """Adds place, from 0, in the order of a unique key of one or more columns: rows are dealt by range and numbered in each range, and only the counts of the ranges meet in one task."""
    keys = [key] if isinstance(key, str) else key
    dealt = scratch.keep(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
    counts = scratch.keep(counts.select("_part", before.alias("_before")), "counts")  # one row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return dealt.withColumn("_inside", inside).join(F.broadcast(counts) if fits_broadcast(counts, 100_000) else counts, "_part").withColumn("place", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


by_value(__name__)
