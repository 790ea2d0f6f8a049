"""Operator 8: personal data by patterns and by bootstrapped contexts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, row_key, text_or_empty
from sightline.llm.spans import apart, count_kind, joined, with_matches

# The contract's patterns, with possessive repeats, and with a look behind where a match cannot begin within a run that has failed; so they
# match the same and take linear time. \G lets a match follow the one before at once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "context"]

#: What a context may reveal: a word with a digit, of five characters or more, whole. It begins where no such word goes on, so each run is read a bounded number of times.
IDENTIFIER = r"(?<![\p{L}\p{N}_@.+-])(?<![\p{L}\p{N}_@.+-]/)(?=[\p{L}_@./+-]*+[0-9])[\p{L}\p{N}_][\p{L}\p{N}_@./+-]{3,}[\p{L}\p{N}]"
#: A context is the last word or two before an identifier, of any length.
WORDS = 2
#: Rounds of the pattern-instance scores; distinct known identifiers that a pattern needs; its least score; the least score of an identifier that counts as known.
ROUNDS, SUPPORT, CONFIDENT, KNOWN = 3, 5, 0.6, 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda i: F.when((n - i) % 2 == 1, digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + twice(i)) % 10 == 0


def with_base(df: DataFrame) -> DataFrame:
    """Adds base, the spans of the fixed kinds in text by start, then kind; matches that fail a check are dropped and not searched again."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        df = with_matches(df, "text", pattern, kind, f"_{kind}", lead=WORDS)
    digits = lambda s: F.regexp_replace(s["body"], "[^0-9]", "")
    ips = F.filter("_1", lambda s: s["body"].rlike(rf"^{part}\.{part}\.{part}\.{part}\z"))
    cards = F.filter(F.filter("_2", lambda s: F.length(digits(s)).between(14, 19)), lambda s: luhn(digits(s)))
    phones = F.filter("_3", lambda s: F.length(digits(s)).between(10, 15))
    return df.withColumn("base", F.array_sort(F.concat("_0", ips, cards, phones))).drop("_0", "_1", "_2", "_3")


def contexts(left: Column) -> Column:
    """array<long>: hashes of the lexical patterns that the text before a place ends with: its last word and its last two, lower-cased, digits alike."""
    norm = F.regexp_replace(F.lower(left), "[0-9]", "0")
    one = F.regexp_extract(norm, r"(?<!\S)(\S++)\s*+\z", 1)
    two = F.regexp_extract(norm, r"(?<!\S)(\S++\s++\S++)\s*+\z", 1)
    return F.array_compact(F.array(F.when(one != "", F.xxhash64(F.lit(1), one)), F.when(two != "", F.xxhash64(F.lit(2), F.regexp_replace(two, r"\s+", " ")))))


def confident_patterns(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, score) of the patterns trusted in the end.

    edges: a written table (pattern, instance, seed), one row per pair. Seeds
    score 1 throughout. A pattern's score is the mean score of its distinct instances, one unknown added; an instance's, the chance that
    one of its patterns with enough known instances is right. Both sides are hash aggregates with partial sums; the tables are written each round.
    """
    scores = scratch.keep(edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score")), "instances")
    patterns = None
    for _ in range(ROUNDS):
        rated = edges.join(scores, "instance").groupBy("pattern").agg(F.sum(F.col("score").cast("decimal(20,9)")).cast("double").alias("sum"), F.count("*").alias("n"), F.count_if(F.col("score") >= KNOWN).alias("known"))
        patterns = scratch.keep(rated.where(F.col("known") >= SUPPORT).select("pattern", (F.col("sum") / (F.col("n") + 1)).alias("score")), "patterns")
        doubt = F.sum(F.log(1 - F.least("p", F.lit(0.999999))).cast("decimal(20,9)"))
        new = edges.join(patterns.withColumnRenamed("score", "p"), "pattern").groupBy("instance").agg((1 - F.exp(doubt.cast("double"))).alias("new"))
        scores = scratch.keep(scores.join(new, "instance", "left").select("instance", F.when(F.col("score") == 1, 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("score")), "instances")
    return patterns.where(F.col("score") >= CONFIDENT)


def personal_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context.

    Base spans follow the contract's patterns and stay as they are. They are
    also the seeds of the method: the words before them are lexical patterns, scored over all documents together with every other
    identifier (a word with a digit) that they precede; those before a trusted pattern and apart from base spans are added as kind context. Null text counts as
    empty; a text without spans has an empty string and its digest. Repeated rows give a row each. An empty table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "personal")
    found = with_base(docs.select("doc_id", text_or_empty().alias("text")))
    found = with_matches(found, "text", IDENTIFIER, 4, "all", lead=WORDS).withColumn("others", apart("all", "base"))
    entity = lambda s, seed: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.xxhash64(F.lower(s["body"])).alias("instance"), F.lit(seed).alias("seed"), contexts(s["left"]).alias("patterns"))
    entities = F.concat(F.transform("base", lambda s: entity(s, True)), F.transform("others", lambda s: entity(s, False)))
    found = scratch.keep(found.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("body"), F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))).alias("base"), entities.alias("entities")), "found")
    each = found.select("doc_id", "body", F.explode("entities").alias("e")).select("doc_id", "body", "e.*")
    edges = scratch.keep(each.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    trusted = confident_patterns(edges, scratch)
    hits = each.where("not seed").select("doc_id", "body", "start", "stop", F.explode("patterns").alias("pattern")).join(trusted, "pattern", "left_semi")
    hits = hits.select(F.col("doc_id").alias("of"), F.col("body").alias("of_body"), F.struct("start", F.lit(4).alias("kind"), "stop").alias("s")).groupBy("of", "of_body").agg(F.collect_set("s").alias("more"))
    out = found.drop("entities").join(hits, (F.col("body") == F.col("of_body")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,stop:int>>")))
    out = out.withColumn("every", F.array_sort(F.concat("base", "more")))
    return out.select("doc_id", *(count_kind("base", k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(joined("base", KINDS), 256).alias("base_sha256"), joined("every", KINDS).alias("spans"), F.size("more").cast("long").alias("n_context"))
