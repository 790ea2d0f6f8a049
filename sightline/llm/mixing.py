"""Operator 10: mixing sources to target weights by entropy balancing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import NOT_WS, Scratch, fits_broadcast, numbered, row_key, text_or_empty

#: A document is taken at most so often, a source to at most so many times its size.
CAP = 3
#: Relative distance to the target at which a source's multiplier is found, and Newton steps at the most.
TOLERANCE, STEPS = 1e-10, 60
#: Sources up to this many are broadcast (the count is checked); more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: A cell (documents of one source and size) with more than this share of all rows is ranked in parts; there are at most the reciprocal number of them.
HOT_SHARE = 1000
EXACT = "decimal(38,9)"


def _key(column: str = "source"):
    """Source as a non-null key that sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col(column)), F.lit("b"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, BROADCAST_SOURCES) else df


def source_targets(sources: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """Adds target to a written table (key, weight, source_size): shares of all words by weight, none above cap times its size.

    The water level, words per unit of weight, rises until the uncapped sources take what the capped ones leave.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        under = F.lit(False) if level is None else F.col("source_size") * cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(under, F.col("source_size") * cap)).alias("full"), F.sum(F.when(~under, F.col("weight"))).alias("w"), F.count_if(under).alias("n")).first()
        if row.n == capped or not row.w:
            break
        level, capped = (total - (row.full or 0)) / row.w, row.n
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(float(level or 0.0))))


def multipliers(cells: DataFrame, targets: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """(key, lam, full): the dual solution of each source, rates being min(cap, exp(lam * size / mean size)).

    Entropy balancing asks for the document rates nearest to 1 in relative
    entropy whose words add up to the target; the dual has one multiplier per source and is convex. Each
    Newton step sums words and slope over the cells in exact decimals, so the order of rows changes nothing; a step that leaves
    the bracket halves it. full marks sources whose target is the cap times their size.
    """
    start = targets.select("key", "target", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"), (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    state = scratch.keep(start.withColumn("done", F.col("full") | (F.col("source_size") == 0)), "newton")
    for _ in range(STEPS):
        if not state.where("not done").limit(1).count():
            break
        tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
        rate = F.least(F.lit(float(cap)), tilt)
        sums = cells.join(_small(state.where("not done").select("key", "lam", "mean")), "key").groupBy("key").agg(
            F.sum((F.col("n") * F.col("size") * rate).cast(EXACT)).cast("double").alias("words"),
            F.sum(F.when(tilt < cap, F.col("n") * F.col("size") * tilt * F.col("size") / F.col("mean")).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"),
        )
        lo, hi = F.when(F.col("words") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("words") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") + F.try_divide(F.col("target") - F.col("words"), F.col("slope"))
        inside = step.isNotNull() & (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi")))
        halved = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.abs(F.col("words") - F.col("target")) <= F.greatest(F.col("target") * TOLERANCE, F.lit(1e-6))
        after = state.join(sums, "key", "left").withColumn("lo", F.coalesce(lo, "lo")).withColumn("hi", F.coalesce(hi, "hi"))
        after = after.withColumn("next", F.when(inside, step).otherwise(halved)).withColumn("near", F.col("done") | near | (F.col("next") == F.col("lam")))
        before, state = state, scratch.keep(after.select("key", "target", "source_size", "mean", "full", F.when(F.col("near"), F.col("lam")).otherwise(F.col("next")).alias("lam"), "lo", "hi", F.col("near").alias("done")), "newton")
        scratch.drop(before)
    else:
        if state.where("not done").limit(1).count():
            raise RuntimeError(f"a source's multiplier was not found in {STEPS} Newton steps")
    return state


def cell_copies(cells: DataFrame, state: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """(key, size, n, copies): whole copies that each cell's n documents get together.

    Rates are added up from small to large documents and rounded as they go,
    so each source misses its target by at most its largest document; then whole documents are added or left out, from large to small as
    long as they fit the gap by their running sum. Each round halves the gap at least or uses up what fits, so the rounds are few. What is left of a gap is smaller than any document that could still close it.
    """
    rate = F.when(F.col("full"), F.lit(float(cap))).when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = cells.join(_small(state.select("key", "lam", "mean", "full", "target")), "key").withColumn("due", (F.col("n") * rate).cast(EXACT))
    sofar = F.sum("due").over(Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    rounded = rated.withColumn("upto", sofar).withColumn("copies", (F.floor(F.col("upto") + F.lit(0.5)) - F.floor(F.col("upto") - F.col("due") + F.lit(0.5))).cast("long"))
    cur = scratch.keep(rounded.select("key", "size", "n", F.least(F.greatest("copies", F.lit(0)), F.col("n") * cap).alias("copies"), "target"), "rounded")
    while True:
        gaps = cur.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        room = F.when(F.col("gap") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        fits = cur.join(_small(scratch.keep(gaps, "gaps")), "key").withColumns({"room": room, "left": F.floor(F.abs("gap"))}).where("size > 0 and room > 0 and size <= left")
        upto = F.sum(F.col("room") * F.col("size")).over(Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
        take = F.least("room", F.floor((F.col("left") - F.col("upto") + F.col("room") * F.col("size")) / F.col("size")))
        fixes = scratch.keep(fits.withColumn("upto", upto).withColumn("take", take).where("take > 0").select("key", "size", (F.col("take") * F.signum("gap")).cast("long").alias("more")), "fixes")
        if not fixes.limit(1).count():
            break
        before, cur = cur, scratch.keep(cur.join(_small(fixes), ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more"), "repaired")
        scratch.drop(before)
    return cur.drop("target")


def _mixed(docs: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """The columns of mix, and the source's key and the row's own."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.keep(docs.select("doc_id", row_key(F.col("doc_id"), text_or_empty()).alias("row"), _key().alias("key"), F.regexp_count(text_or_empty(), F.lit(NOT_WS)).cast("long").alias("size")), "sizes")
    rows = sized.count()
    cells = scratch.keep(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    totals = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sources = scratch.keep(numbered(totals, "key", scratch).withColumn("weight", weight).drop("place"), "sources")
    targets = scratch.keep(source_targets(sources, scratch, cap), "targets")
    copies = cell_copies(cells, multipliers(cells, targets, scratch, cap), scratch, cap)

    part = max(2000, rows // HOT_SHARE)
    hot = cells.where(F.col("n") > part).select("key", "size", F.ceil(F.col("n") / part).cast("int").alias("parts"))  # at most HOT_SHARE rows
    dealt = sized.join(F.broadcast(hot), ["key", "size"], "left").withColumn("h", F.xxhash64("row")).withColumn("part", F.coalesce(F.pmod("h", F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    parts = dealt.groupBy("key", "size", "part").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("key", "size").orderBy("part")) - F.col("m")
    parts = parts.withColumn("before", before).join(copies, ["key", "size"]).select("key", "size", "part", "before", "n", F.col("copies").alias("all"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h", "doc_id", "row")) + F.col("before")
    each = F.floor(F.col("all") / F.col("n")) + F.when(F.col("rank") <= F.col("all") % F.col("n"), 1).otherwise(0)
    ranked = dealt.join(parts, ["key", "size", "part"]).withColumn("rank", rank).withColumn("copies", each.cast("long"))
    return ranked.join(_small(targets.select("key", "source_size", "target")), "key").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "key", "row")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Sources in code-point order, null last, weigh `weights` in turn and share
    all words of the table; a target stops at cap times its source's size, the excess being reshared by weight.
    Size counts runs of other than white space; null text has size 0. copies (0 to cap) is how often the document is taken, taken
    its words times that. A document of size 0 gets one copy, or cap copies in a source that is taken in full measure. Within a cell of equal source and size the
    documents with the smallest hash of doc_id and text get the odd copies, so reruns agree; rows that repeat a doc_id are ranked one by one. An empty table gives an empty one; other columns are ignored.
    """
    return _mixed(docs, weights, cap).drop("key", "row")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """The mix itself: each row of docs, whole, as often as mix takes it.

    Rows equal in source, doc_id and text share their copies: together they are
    taken as often as mix takes them, the first by a hash of all columns getting the odd ones. Rows that share a doc_id alone have counts of their own. Null text has size 0; an
    empty table gives an empty one; other columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    taken = _mixed(docs, weights, cap).groupBy("key", "row").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    taken = scratch.keep(taken, "copies")
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all")
    rows = docs.select(every, _key().alias("own_key"), row_key(F.col("doc_id"), text_or_empty()).alias("own_row"))
    on = (F.col("own_key") == F.col("key")) & (F.col("own_row") == F.col("row"))
    out = rows.join(taken.where("rows = 1 and copies > 0"), on).select("all", "copies")
    repeated = taken.where("rows > 1")
    if repeated.limit(1).count():
        rank = F.row_number().over(Window.partitionBy("key", "row").orderBy(F.xxhash64("all")))
        each = F.floor(F.col("copies") / F.col("rows")) + F.when(rank <= F.col("copies") % F.col("rows"), 1).otherwise(0)
        out = out.union(rows.join(repeated, on).select("all", each.cast("int").alias("copies")).where("copies > 0"))
    return out.select("all", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("all.*")
