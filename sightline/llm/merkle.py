"""Operator 3: document fingerprints, Merkle trees over sections and paragraphs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, fits_broadcast, text_or_empty

#: Where a text is cut into units: before a word, and behind every character (with the white space after it) of the scripts that put no space between words.
UNIT = "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])|(?<=[\\u0E00-\\uD7FF\\uF900-\\uFFFF\\x{10000}-\\x{10FFFF}])(?![\\x20\\x09-\\x0D])"
#: Marks before a leaf, behind a paragraph and behind a section; in leaves these characters and the fourth are written as the fourth and a letter.
MARKS = ("\x00", "\x01", "\x02", "\x03")
#: A leaf begins at one in RATE units, told by the unit's own hash, so an edit moves no other cut; and behind LEAF code points.
RATE, LEAF = 8, 256
#: Hex digits of a section's, a paragraph's and a leaf's node in the fingerprint; the root has all 64.
SECTION_HEX, PARAGRAPH_HEX, LEAF_HEX = 16, 12, 8


def tree(text: Column) -> Column:
    """array<array<array<string>>>: sections, their paragraphs and their leaves, which make up the whole text again; an empty text has none.

    A paragraph ends with a word that line feeds follow, a section with one that an empty line follows, each keeps the white space behind it. Leaves are
    cut by content in any script, and none holds white space alone but in front of the first word. In leaves the characters of MARKS are escaped.
    """
    plain = text
    for mark, name in zip(reversed(MARKS), "dcba", strict=True):
        plain = F.replace(plain, F.lit(mark), F.lit(MARKS[3] + name))
    leaf, paragraph, section, _ = MARKS

    def marked(u: Column) -> Column:
        begins = F.when(F.pmod(F.xxhash64(u), F.lit(RATE)) == 0, F.concat(F.lit(leaf), u)).otherwise(u)
        ends = F.when(F.contains(u, F.lit("\n\n")), section).otherwise(paragraph)
        return F.when(F.contains(u, F.lit("\n")) & u.rlike("[^\\x20\\x09-\\x0D]"), F.concat(begins, ends)).otherwise(begins)

    parts = lambda c, at: F.filter(F.split(c, at), lambda x: x != "")
    return F.transform(parts(F.array_join(F.transform(F.split(plain, UNIT), marked), ""), section), lambda s: F.transform(parts(s, paragraph), lambda p: F.regexp_extract_all(p, F.lit(f"[^\\x00]{{1,{LEAF}}}"), F.lit(0))))


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds name, the fingerprint.

    A leaf's node is the SHA-256 of its text, a paragraph's that of its leaves'
    nodes, a section's that of its paragraphs', the root that of the sections'. The fingerprint reads
    root|section=paragraph:leaf.leaf,paragraph:leaf;section=..., so comparing branches from the root down locates edits and tells how alike
    two texts are; texts have equal roots exactly if they are equal.
    """
    node = lambda below: F.sha2(F.concat_ws("", below), 256)
    df = df.withColumn(f"{name}_leaves", F.transform(tree(F.col(text)), lambda s: F.transform(s, lambda p: F.transform(p, lambda x: F.sha2(x, 256)))))
    df = df.withColumn(f"{name}_nodes", F.transform(f"{name}_leaves", lambda s: F.transform(s, node)))
    df = df.withColumn(f"{name}_sections", F.transform(f"{name}_nodes", node))
    short = lambda x, n: F.substring(x, 1, n)
    df = df.withColumn(f"{name}_lines", F.zip_with(f"{name}_nodes", f"{name}_leaves", lambda ps, ls: F.array_join(F.zip_with(ps, ls, lambda p, l: F.concat(short(p, PARAGRAPH_HEX), F.lit(":"), F.array_join(F.transform(l, lambda x: short(x, LEAF_HEX)), "."))), ",")))
    branches = F.array_join(F.zip_with(f"{name}_sections", f"{name}_lines", lambda s, p: F.concat(short(s, SECTION_HEX), F.lit("="), p)), ";")
    return df.withColumn(name, F.concat(node(F.col(f"{name}_sections")), F.lit("|"), branches)).drop(*(f"{name}_{c}" for c in ("leaves", "nodes", "sections", "lines")))


def _numbered(df: DataFrame, *columns: str) -> DataFrame:
    """Each array of strings sorted, its items numbered among their equals (x#0, x#1, ...): sets of those are bags of the items."""
    df = df.withColumns({c: F.sort_array(c) for c in columns})
    first = lambda c: F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(F.col(c), i) != F.get(F.col(c), i - 1)))
    df = df.withColumns({f"{c}_first": F.when(F.size(c) > 0, first(c)).otherwise(F.array().cast("array<int>")) for c in columns})
    last = lambda c, k: F.coalesce(F.get(F.col(f"{c}_first"), k + 1), F.size(c)) - 1
    each = lambda c: F.flatten(F.transform(f"{c}_first", lambda b, k: F.transform(F.sequence(b, last(c, k)), lambda i: F.concat(F.get(F.col(c), i), F.lit("#"), (i - b).cast("string")))))
    return df.withColumns({c: each(c) for c in columns}).drop(*(f"{c}_first" for c in columns))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds name: how alike the texts of two fingerprint columns are, 0 to 1.

    Descends both trees from the root: sections with equal nodes are set aside in pairs, then the paragraphs of the rest, then the leaves of the rest of those. The likeness is
    the share of all leaves that was set aside; equal roots (empty texts too) have 1.
    """
    below = lambda at: lambda c: F.filter(F.split(F.substring_index(c, at, -1), {"|": ";", "=": ",", ":": "[.]"}[at]), lambda x: x != "")
    x, y = f"{name}_x", f"{name}_y"
    leaves = lambda c: F.coalesce(F.size(F.regexp_extract_all(F.substring_index(c, "|", -1), F.lit(f"(?<=[:.])[0-9a-f]{{{LEAF_HEX}}}"), F.lit(0))), F.lit(0))
    df = df.withColumns({x: below("|")(F.col(a)), y: below("|")(F.col(b))})
    for at in ("=", ":", None):
        df = _numbered(df, x, y)
        rest = lambda p, q: F.transform(F.array_except(p, q), lambda n: F.substring_index(n, "#", 1))
        df = df.withColumns({x: rest(x, y), y: rest(y, x)})
        if at:
            df = df.withColumns({c: F.flatten(F.transform(c, below(at))) for c in (x, y)})
    n = leaves(F.col(a)) + leaves(F.col(b))
    return df.withColumn(name, F.when(n > 0, F.lit(1.0) - (F.size(x) + F.size(y)) / n).otherwise(1.0)).drop(x, y)


def differing_branches(a: str, b: str) -> Column:
    """array<struct<section, paragraph>>, counted from 0: where two fingerprints differ. Equal roots have none; a branch whose nodes are equal isn't entered."""
    sections = lambda c: F.split(F.split_part(F.col(c), F.lit("|"), F.lit(2)), ";")
    left, right = sections(a), sections(b)
    node = lambda arr, i: F.coalesce(F.get(arr, i), F.lit(""))

    def inside(i):
        x, y = (F.transform(F.split(F.substring_index(node(c, i), "=", -1), ","), lambda p: F.substring_index(p, ":", 1)) for c in (left, right))
        places = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
        return F.transform(F.filter(places, lambda j: node(x, j) != node(y, j)), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)) - 1), lambda i: F.substring_index(node(left, i), "=", 1) != F.substring_index(node(right, i), "=", 1))
    return F.when(F.split_part(F.col(a), F.lit("|"), F.lit(1)) == F.split_part(F.col(b), F.lit("|"), F.lit(1)), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(F.transform(places, inside)))


def next_ids(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, next_key) for distinct keys: the next smaller one, and the largest for the smallest.

    Keys are dealt by range; each range looks behind itself, and its lowest key looks at the range below, of which only the bounds are read.
    """
    dealt = scratch.keep(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranges")
    bounds = dealt.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    row = Window.orderBy("part")  # one row per range
    bounds = scratch.keep(bounds.select("part", F.coalesce(F.lag("hi").over(row), F.max("hi").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below")), "bounds")
    inner = dealt.withColumn("behind", F.lag("key").over(Window.partitionBy("part").orderBy("key")))
    return inner.join(F.broadcast(bounds) if fits_broadcast(bounds, 100_000) else bounds, "part").select("key", F.coalesce("behind", "below").alias("next_key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document by descending doc_id; the last is followed by the first, a single document by itself.
    near_edited and near_next are the likeness (0 to 1) of the fingerprint to the edited text's and to the next document's. Null text counts as empty; a missing doc_id comes last. Of rows
    that repeat a doc_id the smallest beginning of a text is the one that others take. An empty table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    key = F.struct(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    base = docs.select(key.alias("key"), text_or_empty().alias("text"))
    halves = scratch.keep(base.groupBy("key").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("half")), "halves")
    follow = scratch.keep(next_ids(halves.select("key"), scratch).join(halves, "key"), "next")
    # both joins read the same two columns of docs by key, so one shuffle of the texts serves them
    begin = base.join(follow.select(F.col("next_key").alias("key"), F.col("key").alias("taker"), "half").hint("merge"), "key")
    begin = begin.select(F.col("taker").alias("key"), F.expr("substring(text, 1, half)").alias("begin")).groupBy("key").agg(F.min("begin").alias("begin"))
    own = base.join(begin.hint("merge"), "key").withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = own.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - half), substring(begin, 1, half))")).drop("begin", "half")
    both = fingerprint(fingerprint(edited, "text", "fingerprint"), "edited", "edited_fingerprint")
    trees = scratch.keep(both.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "trees")
    after = trees.groupBy("key").agg(F.min("fingerprint").alias("next_fingerprint")).withColumnRenamed("key", "next_key")
    near = follow.select("key", "next_key").join(after, "next_key").select("key", "next_fingerprint")
    out = with_likeness(with_likeness(trees.join(near, "key"), "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return out.select(F.when(F.col("key.there"), F.col("key.id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
