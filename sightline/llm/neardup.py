"""Near-duplicate components over banded circulant MinHash, shared by whole-document and paragraph deduplication.

Candidates come from equal bands; every link is confirmed on full shingle
sets. Items with equal sets become one class before any pairing. In a bucket of m classes, m - 1 pairs with the smallest
are tried first; a bucket that is then in one component is finished. The others are cut into blocks of
about BLOCK classes or SHINGLES shingles, and each pair of blocks is compared in one task, which
returns at most a spanning forest of new links. So no pair of a bucket goes unchecked
unless its ends are already connected, no task holds more than two blocks, and no table of all pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, by_value, fits_broadcast, slices
from sightline.llm.graph import components
from sightline.llm.kernels import band_keys, circulant_signatures, fingerprint, list_array, shingle_sets, string_buffer, words

BLOCK = 512
#: Shingles of a block, about: blocks of large sets hold fewer classes, so that what a task holds doesn't follow the length of texts.
SHINGLES = 1 << 20
#: Texts hashed at a time.
ROWS = 1000
#: Shared band keys up to this many (12 MB) are broadcast; more are joined by a shuffle.
BUCKETS = 500_000
#: Cells of the 0/1 matrix of one comparison at a time.
CELLS = 1 << 23


def signature_batches(bands: int, rows: int, carried: int):
    """mapInArrow function: the first `carried` columns, then n (set size), fp (of the set) and bands, for a last column of text."""

    def run(batches):
        for batch in slices(batches, ROWS):
            buf, offsets = string_buffer(batch.column(carried))
            h, counts, _ = words(buf, offsets)
            sets = shingle_sets(h, counts)
            some = [s for s in sets if len(s)]
            keys = band_keys(circulant_signatures(some, bands * rows), bands, rows) if some else np.zeros((0, bands), np.uint64)
            full, none = iter(keys), np.zeros(0, np.uint64)
            cols = [*batch.columns[:carried], pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), list_array([next(full) if len(s) else none for s in sets])]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:carried], "n", "fp", "bands"])

    return run


def set_batches(carried: int):
    """mapInArrow function: the first `carried` columns, then fingerprint and shingle set of the last column's text."""

    def run(batches):
        for batch in slices(batches, ROWS):
            buf, offsets = string_buffer(batch.column(carried))
            h, counts, _ = words(buf, offsets)
            sets = shingle_sets(h, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], pa.array([fingerprint(s) for s in sets], pa.binary()), list_array(sets)], [*batch.schema.names[:carried], "fp", "hashes"])

    return run


def _forest(comps: list[int], num: int, den: int, values: np.ndarray, sizes: np.ndarray, left: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links between different components among the rows of one pair of blocks, no more than join them. values: their shingles one after the other, sizes of each; left: of the first block."""
    parent: dict = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    total = len(sizes)
    rows, cols = (np.arange(total),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
    if not len(rows) or not len(cols):
        return []
    order = np.argsort(values, kind="stable")
    owner, values = np.repeat(np.arange(total), sizes)[order], values[order]
    at = np.cumsum(np.append(True, values[1:] != values[:-1])) - 1
    # a shingle of one set alone adds nothing to an intersection
    shared = np.bincount(at) > 1
    keep = shared[at]
    at, owner = (np.cumsum(shared) - 1)[at[keep]], owner[keep]
    width = int(shared.sum())
    inter = np.zeros((len(rows), len(cols)), dtype=np.float32)
    step = max(1, CELLS // total)
    for lo in range(0, width, step):
        a, b = np.searchsorted(at, (lo, lo + step))
        m = np.zeros((total, min(step, width - lo)), dtype=np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        inter += (m if same else m[rows]) @ (m if same else m[cols]).T
    common = inter.astype(np.int64)
    linked = den * common >= num * (sizes[rows][:, None] + sizes[cols][None, :] - common)
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = comps[rows[i]], comps[cols[j]]
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def block_links(num: int, den: int):
    """mapInArrow function over (key, i, j, rep, comp, block, hashes) in the order of key, i, j and rep: pairs of blocks follow each other, and one that has not ended with a batch waits for the next."""

    def links(part: pa.Table | pa.RecordBatch, i: int, j: int) -> list[tuple[int, int]]:
        hashes = part.column("hashes")
        lists = hashes.chunks if isinstance(hashes, pa.ChunkedArray) else [hashes]
        values = np.concatenate([x.flatten().to_numpy() for x in lists])
        sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int64)
        return _forest(part.column("comp").to_pylist(), num, den, values, sizes, part.column("block").to_numpy() == i, i == j)

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            begins, out = [0, *cuts.tolist()], []
            for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                now = (int(key[a]), int(i[a]), int(j[a]))
                if held and now != last:
                    out += links(held[0] if len(held) == 1 else pa.Table.from_batches(held), *last[1:])
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
            yield _pairs(out)
        if held:
            yield _pairs(links(held[0] if len(held) == 1 else pa.Table.from_batches(held), *last[1:]))

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def link_classes(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and the components that links between them form.

    items: a written table (row long, order, n, fp, bands), one row an item,
    without empty sets; row finds an item's text again, order decides among items. sets_of takes a table (rep, row, fp), one row a class, and returns (fp, hashes)
    for these at least, repeats allowed. Sets link when den * intersection >= num * union. Returns (fp, rep, least, size),
    rep a number for the class, least the smallest order in it, and (id, component) for the classes that have a link; the rest are alone.
    """
    found = items.groupBy("fp").agg(F.min("row").alias("row"), F.min("order").alias("least"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.keep(found.withColumn("rep", F.monotonically_increasing_id()), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = scratch.keep(keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("m")).where("m > 1"), "buckets")
    # the keys are not shuffled a second time if those that are shared are counted to be few
    members = scratch.keep(keys.join(F.broadcast(buckets) if fits_broadcast(buckets, BUCKETS) else buckets, "key"), "members")
    some = members.select("rep").distinct()
    wanted = scratch.keep(classes.select("rep", "row", "fp", "n").join(F.broadcast(some) if fits_broadcast(buckets, BUCKETS // 4) else some, "rep", "left_semi"), "wanted")
    sets = scratch.keep(sets_of(wanted).groupBy("fp").agg(F.first("hashes").alias("hashes")).join(wanted.select("fp", "rep"), "fp").select("rep", "hashes"), "sets")

    left = sets.select("rep", F.col("hashes").alias("x"))
    right = sets.select(F.col("rep").alias("leader"), F.col("hashes").alias("y"))
    sizes = wanted.select("rep", "n")
    pairs = members.where("rep <> leader").select("rep", "leader").distinct()
    pairs = pairs.join(sizes.withColumnRenamed("n", "nx"), "rep").join(sizes.select(F.col("rep").alias("leader"), F.col("n").alias("ny")), "leader")
    # sizes too far apart cannot link: the intersection is at most the smaller, the union at least the larger
    pairs = pairs.where(F.lit(den) * F.least("nx", "ny") >= F.lit(num) * F.greatest("nx", "ny"))
    same = F.size(F.array_intersect("x", "y")).cast("long")
    stars = pairs.join(left, "rep").join(right, "leader").withColumn("common", same).where(F.lit(den) * F.col("common") >= F.lit(num) * (F.col("nx") + F.col("ny") - F.col("common")))
    links = scratch.keep(stars.select(F.col("rep").alias("u"), F.col("leader").alias("v")), "stars")
    first = scratch.keep(components(links, scratch), "first")

    placed = members.where("m > 2").join(first, members["rep"] == first["id"], "left").select("key", "rep", "m", F.coalesce("component", "rep").alias("comp"))
    placed = scratch.keep(placed.join(sizes, "rep"), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("m"), F.min("rep").alias("leader"), F.sum("n").alias("shingles")).where("lo <> hi")
    # of buckets with the same members one is enough
    mixed = mixed.groupBy("m", "sum", "lo", "hi", "leader", "shingles").agg(F.min("key").alias("key")).select("key", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / SHINGLES)).cast("int").alias("blocks"))
    rows = placed.drop("m", "n").join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "rep", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = rows.join(sets, "rep").select("key", "i", "j", "rep", "comp", "block", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    more = dealt.mapInArrow(block_links(num, den), "u long, v long")
    more = scratch.keep(more, "blocks")
    if more.limit(1).count():
        # joins of components, by their labels; what has a link is in `first` or alone
        second = scratch.keep(components(more, scratch), "second")
        ids = first.select("id", "component").union(more.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(first, "id", "left_anti").select("id", F.col("id").alias("component")))
        to = second.select(F.col("id").alias("component"), F.col("component").alias("top"))
        first = scratch.keep(ids.join(to, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "joined")
    return classes.select("fp", "rep", "least", "size"), first


def class_components(classes: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, component, owner) of the classes with more than one item or a link: owner is the smallest order in the component."""
    known = classes.join(linked, classes["rep"] == linked["id"], "left").where("size > 1 or component is not null").select("fp", F.coalesce("component", "rep").alias("component"), "least")
    known = scratch.keep(known, "known")
    tops = scratch.keep(known.groupBy("component").agg(F.min("least").alias("owner")), "tops")
    return known.select("fp", "component").join(F.broadcast(tops) if fits_broadcast(tops, BUCKETS) else tops, "component")


by_value(__name__)
