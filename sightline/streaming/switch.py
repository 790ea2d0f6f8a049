"""The kill switch of a stream: who may act just now, read anew by version once it is older than its time to live."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.streaming.landing import folders, land

FLAGS = "pause_all boolean, reason string"
#: Accounts up to this many are broadcast, by their count.
FEW = 1_000_000


def set_pause(spark: SparkSession, store: str, paused: bool, reason: str = "") -> None:
    """Adds a version of the flags; the newest holds."""
    land(spark.createDataFrame([(paused, reason)], FLAGS), f"{store}/flags")


def set_accounts(accounts: DataFrame, store: str) -> None:
    """Adds a version of the accounts (account_id, enabled)."""
    land(accounts.select("account_id", "enabled"), f"{store}/accounts")


def stored(spark: SparkSession, store: str) -> Callable[[float], tuple[tuple[bool, str], DataFrame]]:
    """Reads the newest version of flags and accounts. Both are folders that are never written again, so what was read stays as it is."""

    def read(_: float):
        newest = {}
        for part in ("flags", "accounts"):
            done = folders(spark, f"{store}/{part}")
            if not done:
                raise LookupError(f"no {part} under {store}")
            newest[part] = f"{store}/{part}/{done[-1]}"
        flags = spark.read.schema(FLAGS).parquet(newest["flags"]).first()  # one row
        return (flags.pause_all, flags.reason), spark.read.parquet(newest["accounts"])

    return read


@dataclass
class Switch:
    """Holds what `read` gave for `ttl` seconds of the clock that its callers name. A failed read is not held: it refuses what was asked, and the next asks again."""

    read: Callable[[float], tuple[tuple[bool, str], DataFrame]]
    ttl: float
    fetched: float | None = field(default=None, init=False)
    held: tuple | None = field(default=None, init=False)

    def state(self, now: float) -> tuple[tuple[bool, str], DataFrame]:
        if self.fetched is None or now - self.fetched > self.ttl:
            self.fetched = None
            self.held = self.read(now)
            self.fetched = now
        return self.held

    def judge(self, rows: DataFrame, now: float) -> DataFrame:
        """Adds verdict to rows with account_id: free, paused (and why), disabled, unknown for an account that isn't there, or unreadable; all but free may not act."""
        try:
            (paused, reason), accounts = self.state(now)
        except Exception as e:  # noqa: BLE001  whatever keeps it from being read, nothing may act
            return rows.withColumn("verdict", F.lit("unreadable")).withColumn("why", F.lit(str(e)[:200]))
        known = accounts.select("account_id", "enabled")
        known = F.broadcast(known) if known.limit(FEW + 1).count() <= FEW else known
        verdict = F.when(F.lit(paused), "paused").when(F.col("enabled").isNull(), "unknown").when(~F.col("enabled"), "disabled").otherwise("free")
        return rows.join(known, "account_id", "left").withColumn("verdict", verdict).withColumn("why", F.when(F.lit(paused), F.lit(reason))).drop("enabled")


def judged(switch: Switch, clock: Callable[[DataFrame, int], float]) -> Callable[[DataFrame, int], DataFrame]:
    """What a sink makes of a batch: its rows with their verdicts, by the switch as of the batch's moment."""
    return lambda batch, number: switch.judge(batch, clock(batch, number))
