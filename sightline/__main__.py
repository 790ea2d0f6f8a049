"""python -m sightline: lists the registered queries, runs one over a folder of tables, makes the store's tables, lands captures in a queue, or pauses and resumes what a kill switch guards."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sightline.config import Settings
from sightline.plans import registry
from sightline.sources import schemas
from sightline.streaming import landing, switch


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sightline")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query", choices=sorted(registry.QUERIES), metavar="QUERY")
    run.add_argument("folder")
    run.add_argument("--out", help="writes Parquet there instead of showing rows")
    make = sub.add_parser("migrate")
    make.add_argument("database")
    for name in ("pause", "resume"):
        flip = sub.add_parser(name, help="adds a version of the flags to a switch's store")
        flip.add_argument("store")
        flip.add_argument("--reason", default="")
    put = sub.add_parser("land", help="puts a folder of Parquet captures at the end of a queue")
    put.add_argument("captures")
    put.add_argument("queue")
    got = p.parse_args(args)
    if got.what == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    settings = Settings.load()
    spark = SparkSession.builder.appName("sightline").config("spark.sql.warehouse.dir", settings.warehouse).config("spark.sql.shuffle.partitions", settings.shuffle_partitions).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if got.what == "migrate":
        print("\n".join(schemas.migrate(spark, got.database)))
    elif got.what in ("pause", "resume"):
        switch.set_pause(spark, got.store, got.what == "pause", got.reason)
        print("paused" if got.what == "pause" else "running")
    elif got.what == "land":
        print(landing.land(spark.read.parquet(got.captures), got.queue))
    else:
        df = registry.QUERIES[got.query](spark, got.folder)
        df.write.mode("error").parquet(got.out) if got.out else df.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
