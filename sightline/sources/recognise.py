"""Text recognisers as callables over image crops, one call a batch; none is bundled."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

READ = "text string, confidence double"


def recognised(crops: DataFrame, engine: Callable[[Iterable[bytes]], Iterable[tuple[str, float]]], key: list[str], wrap: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(key, text, confidence) of crops (key, png): the engine reads them in batches on the executors; wrap may change an image before it is read."""
    kinds = ", ".join(f"{c} {crops.schema[c].dataType.simpleString()}" for c in key)

    def run(batches):
        for pdf in batches:
            images = [wrap(bytes(x)) if wrap else bytes(x) for x in pdf["png"]]
            got = list(engine(images))
            if len(got) != len(images):
                raise ValueError("the engine read another number of images than it was given")
            out = pdf[key].copy()
            out["text"], out["confidence"] = [t for t, _ in got], [float(c) for _, c in got]
            yield out

    return crops.select(*key, "png").mapInPandas(run, f"{kinds}, {READ}")


def scripted(crops: DataFrame, script: DataFrame, key: str) -> DataFrame:
    """Reads taken from a script (n, text, confidence) in order of the key, for tests; fewer lines than crops are an error."""
    numbered = crops.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("n"))  # a script is a handful of rows
    missing = numbered.join(script, "n", "left_anti").limit(1).collect()  # one row
    if missing:
        raise LookupError(f"the script ends before {missing[0][key]}")
    return numbered.join(script, "n").select(key, "text", "confidence")


def accepted(reads: DataFrame, least: float) -> DataFrame:
    return reads.where(F.col("confidence") >= least)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
