"""Rows that are looked up, written, changed and removed by key. Tables are values: each function returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class NotFound(LookupError):
    """No row answers to a key that must exist."""


def lookup(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that answer to a key; without any, NotFound. One limited job decides, so the filter reaches the scan."""
    found = df.where(condition)
    if not found.limit(1).count():
        raise NotFound(str(condition))
    return found


def null_if_blank(c) -> Column:
    return F.nullif(c, F.lit(""))


def ordered(df: DataFrame, *by) -> DataFrame:
    """A result in order; the last column of the order must be unique, so that reruns agree."""
    return df.orderBy(*by)


def chain(accounts: DataFrame, instances: DataFrame, devices: DataFrame, serials: list[str] | None = None) -> DataFrame:
    """Accounts with their app instance and its device, of the serials given or of all."""
    wanted = devices if serials is None else devices.where(F.col("serial").isin(serials))
    return accounts.join(instances, "instance_id").join(wanted, "device_id")


def with_flags(accounts: DataFrame, flags: DataFrame) -> DataFrame:
    """Each account with the one row of flags."""
    return accounts.crossJoin(F.broadcast(flags.limit(1)))  # the flags are a single row by their key


def kill_state(paused, enabled) -> Column:
    """A pause of everything goes before an account that is switched off."""
    return F.when(paused, "paused").when(~enabled, "disabled").otherwise("ok")


def run_outcome(error) -> Column:
    """Status of a finished run by its error: none succeeded; a pause or a disabled account is no failure."""
    return F.when(error.isNull(), "succeeded").when(error.isin("paused", "account disabled"), "paused").otherwise("failed")


def insert_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A plain insert: new rows, each with whether its key is taken, by a stored row or another new one."""
    repeated = new.groupBy(*key).agg((F.count("*") > 1).alias("_twice"))
    taken = existing.select(*key, F.lit(True).alias("_taken")).dropDuplicates(key)
    return new.join(repeated, key).join(taken, key, "left").withColumn("conflict", F.col("_twice") | F.coalesce("_taken", F.lit(False))).drop("_twice", "_taken")


def update(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the columns of changed rows replaced; a change of a key that isn't there comes back with found false and null elsewhere."""
    c = changes.select(F.col(key), F.struct(*columns).alias("_new"))
    out = df.withColumn("_old", F.lit(True)).join(c, key, "full_outer")
    each = [F.col(f"_new.{x}").alias(x) if x in columns else F.col(x) for x in df.columns if x != key]
    kept = [F.when(F.col("_new").isNotNull() & F.col("_old").isNotNull(), e).otherwise(F.col(x)).alias(x) for x, e in zip([x for x in df.columns if x != key], each, strict=True)]
    return out.select(key, *kept, F.coalesce("_old", F.lit(False)).alias("found"))


def refresh_latest(old: DataFrame, new: DataFrame, key: list[str], take: list[str], order: str) -> DataFrame:
    """Upsert in which the latest new row refreshes the columns in take; the others keep what the first row had."""
    rest = [c for c in old.columns if c not in key and c not in take]
    w = Window.partitionBy(*key)
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    rank = F.row_number().over(w.orderBy(F.desc("_new"), F.desc(order)))
    first = w.orderBy("_new", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(*key, *take, *(F.first(c).over(first).alias(c) for c in rest), rank.alias("_rank")).where("_rank = 1").select(*old.columns)


def fold_runs(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Runs as their two events leave them: running from the start, then as the first finish says. A finish without a start is dropped."""
    done = finishes.groupBy("run_id").agg(F.min_by(F.struct("status", "ended_at"), F.struct("ended_at", "status")).alias("_f"))
    return starts.join(done, "run_id", "left").select(*starts.columns, F.coalesce("_f.status", F.lit("running")).alias("status"), F.col("_f.ended_at").alias("ended_at"))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those that are deleted, and the children of these."""
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(F.col(key).alias(parent)), parent, "left_anti")


def record_capture(captures: DataFrame, frames: DataFrame) -> DataFrame:
    """Captures with the number of their frames, numbered without gaps from 0 in seq order or else refused, so that frames and header are published together."""
    seen = frames.groupBy("capture_id").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("distinct"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    sound = (F.col("n") == F.col("distinct")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    return captures.join(seen, "capture_id", "left").select(*captures.columns, F.coalesce("n", F.lit(0)).alias("frames"), F.coalesce(sound, F.lit(False)).alias("sound"))


CANDIDATES = "array<struct<member_id:bigint,name:string,score:bigint>>"


def queued(rows: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Review items with all their candidates (key, member_id, name, score) as JSON, in order of score, then member; a confidence of 0 is stored as none. A row's candidates are a roster at the most."""
    packed = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_n"), "member_id", "name", "score"))).alias("_c"))
    plain = F.transform(F.coalesce("_c", F.array().cast("array<struct<_n:bigint,member_id:bigint,name:string,score:bigint>>")), lambda x: F.struct(x["member_id"].alias("member_id"), x["name"].alias("name"), x["score"].alias("score")))
    return rows.join(packed, key, "left").withColumn("candidates_json", F.to_json(plain)).withColumn("confidence", F.nullif("confidence", F.lit(0.0))).drop("_c")


def candidates_of(json) -> Column:
    """Read side of queued."""
    return F.from_json(json, CANDIDATES)


def observations(shots: DataFrame, stored: DataFrame, key: str = "sha256") -> DataFrame:
    """Each capture is a row of its own, with whether its bytes were stored already, before or by an earlier shot."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("shot_id"))
    known = stored.select(key, F.lit(True).alias("_known")).dropDuplicates([key])
    return shots.withColumn("_nth", nth).join(known, key, "left").withColumn("existed", F.coalesce("_known", F.lit(False)) | (F.col("_nth") > 1)).drop("_nth", "_known")


def durations(runs: DataFrame, by: str) -> DataFrame:
    """Longest and mean seconds of finished runs."""
    took = F.col("ended_at") - F.col("started_at")
    return runs.where("ended_at is not null").groupBy(by).agg(F.max(took).alias("longest"), F.round(F.avg(took), 6).alias("mean"), F.count("*").alias("n"))


def stuck(status, started_at, now, seconds: int) -> Column:
    """A run still called running after so long is evidence of a crash."""
    return (status == "running") & (started_at < now - seconds)


def whole_captures(facts: DataFrame, captures: DataFrame) -> DataFrame:
    """Facts of complete captures only: partial ones don't count in derived metrics."""
    return facts.join(captures.where("status = 'complete'").select("capture_id"), "capture_id", "left_semi")
