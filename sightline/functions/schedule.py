"""Deterministic hashes behind offline windows and the jitter of cadences, in the JVM: 64-bit words as two halves in longs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 64 bits; the prime is 2**40 + TAIL.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
TAIL = PRIME - (1 << 40)
WORD, HALF = 1 << 64, 1 << 32
#: Minutes of a day, the shortest window, and by how many more minutes it may last.
DAY, SHORTEST, MORE = 1440, 300, 121


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bytes(text: Column) -> Column:
    """array<int>: the UTF-8 bytes of a string that isn't empty."""
    wide = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.when(F.octet_length(text) == F.length(text), F.transform(F.split(text, ""), F.ascii)).otherwise(wide)


def fnv1a(*parts: Column) -> Column:
    """Unsigned FNV-1a over the bytes of the parts, each ended by a zero byte, as struct(hi, lo) of 32-bit halves.

    Times the prime is times TAIL, which keeps a half below 2**41, and a shift by 40 bits, which moves the lower half's lowest 24 bits into the upper.
    """

    def step(h, byte):
        def times(lo):
            small = lo * TAIL
            return F.struct(((h["hi"] * TAIL + F.shiftright(small, 32) + F.shiftleft(lo, 8)) % HALF).alias("hi"), (small % HALF).alias("lo"))

        return let(h["lo"].bitwiseXOR(byte.cast("long")), times)

    start = F.struct(F.lit(OFFSET >> 32).cast("long").alias("hi"), F.lit(OFFSET % HALF).cast("long").alias("lo"))
    return F.aggregate(_bytes(F.concat(*(F.concat(p, F.lit("\x00")) for p in parts))), start, step)


def number(h: Column) -> Column:
    """The hash as decimal(20,0)."""
    return (h["hi"].cast("decimal(20,0)") * F.lit(HALF).cast("decimal(11,0)") + h["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")


def residue(h: Column, n: int) -> Column:
    return ((h["hi"] % n * (HALF % n) + h["lo"]) % n).cast("int")


def quotient_residue(h: Column, n: int, m: int) -> Column:
    """(h div n) mod m, exactly; n below 2**30, m below 2**15."""
    whole = F.floor(h["hi"] / n).cast("long")
    return ((whole % m * (HALF % m) + F.floor(((h["hi"] % n) * HALF + h["lo"]) / n).cast("long")) % m).cast("int")


def offline_minutes(account: Column, day: Column) -> Column:
    """struct(start, minutes): first minute and length (5 to 7 hours) of an account's offline window on a day 'yyyy-mm-dd'."""
    return let(fnv1a(account.cast("string"), day), lambda h: F.struct(residue(h, DAY).alias("start"), (quotient_residue(h, DAY, MORE) + SHORTEST).alias("minutes")))


def offline(account: Column, now: Column) -> Column:
    """Whether a moment lies in the account's window of that day or of the day before, which may run past midnight."""
    minute = (F.unix_micros(now) - F.unix_micros(F.date_trunc("day", now))) / 60e6

    def inside(day: Column, late: int) -> Column:
        return let(offline_minutes(account, F.date_format(day, "yyyy-MM-dd")), lambda w: (minute + late >= w["start"]) & (minute + late < w["start"] + w["minutes"]))

    return inside(now, 0) | inside(now - F.expr("interval 1 day"), DAY)


def cadence_offset(account: Column, task: Column, last_ns: Column, cadence_ns: Column) -> Column:
    """Nanoseconds by which a run is put off or brought forward: up to a fifth of the cadence, by the last run."""
    share = residue(fnv1a(account.cast("string"), task, last_ns.cast("string")), 40001).cast("double") / 40000.0 * 0.4 - 0.2
    return (share * cadence_ns.cast("double")).cast("long")
