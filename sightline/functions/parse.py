"""Parsers of noisy text fields as Catalyst expressions; what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c) -> Column:
    return F.regexp_replace(_col(c), r"^\s+|\s+\z", "")


def power(c) -> Column:
    """'Power: 12.3M' to 12300000: one decimal and a unit are mandatory; halves round away from zero."""
    t = F.upper(trimmed(F.regexp_replace(trimmed(c), r"(?i)^power:", "")))
    unit = F.substring(t, -1, 1)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1e9)
    return F.when(t.rlike(r"^[0-9]+\.[0-9][KMB]\z"), F.round(F.regexp_extract(t, r"^([0-9]+\.[0-9])", 1).try_cast("double") * scale).try_cast("long"))


def level(c) -> Column:
    """'Lv. 30' to 30; one full stop or blank, and a repeated lv in small letters, may stand before the digits."""
    return F.regexp_extract(trimmed(c), r"^(?i:lv)\s*[. ]?\s*(?:lv\.?)?\s*([0-9]+)\z", 1).try_cast("int")


def last_active_hours(c) -> Column:
    """'Online' to 0, '3h ago', '2d' and '30m ago' to hours."""
    t = F.lower(trimmed(c))
    n = F.regexp_extract(t, r"^([0-9]+)\s*[mhd](?:\s*ago)?\z", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^[0-9]+\s*([mhd])", 1)
    return F.when(t.startswith("online"), 0.0).otherwise(n * F.when(unit == "m", 1 / 60).when(unit == "h", 1.0).when(unit == "d", 24.0))


def points(c) -> Column:
    """'1,234,567' to 1234567; groups of three are mandatory past three digits."""
    t = trimmed(c)
    return F.when(t.rlike(r"^[0-9]{1,3}(,[0-9]{3})*\z"), F.replace(t, F.lit(","), F.lit("")).try_cast("long"))


def abbreviated(c) -> Column:
    """'1.5K', '2M' or '37' to a whole number."""
    t = F.upper(F.replace(trimmed(c), F.lit(","), F.lit("")))
    unit = F.regexp_extract(t, r"([KMB])\z", 1)
    n = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*[KMB]?\z", 1).try_cast("double")
    return F.round(n * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)).try_cast("long")


def group_header(c) -> Column:
    """struct(name, online, total) of 'Raiders 3/25': exactly one N/M, without blanks in it, with 0 < M and N at most M."""
    t = trimmed(c)
    n, m = (F.regexp_extract(t, "([0-9]+)/([0-9]+)", g).try_cast("long") for g in (1, 2))
    good = (F.regexp_count(t, F.lit("[0-9]+/[0-9]+")) == 1) & (m > 0) & (n <= m)
    return F.when(good, F.struct(trimmed(F.regexp_extract(t, r"(?s)^(.*?)[0-9]+/", 1)).alias("name"), n.alias("online"), m.alias("total")))


def member_count(c) -> Column:
    """N of 'Members: N / M'."""
    return F.regexp_extract(_col(c), r"(?i)members:\s*([0-9]+)\s*/\s*[0-9]+", 1).try_cast("int")


def without(c, characters: str) -> Column:
    return F.translate(_col(c), characters, "")


def without_artifact(c) -> Column:
    """Drops the trailing run of other than digits and commas."""
    return F.regexp_replace(_col(c), r"[^0-9,]+\z", "")


def digits(c) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")


def repaired_points(c, lo, hi) -> Column:
    """The one reading of a number with exactly one damaged character that is a digit and lies within the bounds; null if none or several do.

    With the character read as 0, each step of the digit adds its place value, so the digits that fit are those between two quotients. Numbers of 19 digits and more are no reading.
    """
    t = trimmed(c)
    damaged = t.rlike(r"^[0-9,]*[^0-9,][0-9,]*\z") & (F.length(F.replace(t, F.lit(","), F.lit(""))) <= 18)
    after = F.length(F.replace(F.regexp_extract(t, r"([0-9,]*)\z", 1), F.lit(","), F.lit("")))
    base = points(F.regexp_replace(t, F.lit("[^0-9,]"), "0"))

    def digit(x: Column) -> Column:
        # whole numbers are kept apart from doubles: bounds can be as wide as a long
        step = F.rpad(F.lit("1"), x["after"] + 1, "0").cast("long")
        gap = lambda v: F.greatest(F.lit(-1).cast("long"), F.least(F.lit(10 ** 18), v)) - x["base"]
        up = F.greatest(F.lit(0).cast("long"), _ceil(gap(x["lo"]), step))
        down = F.least(F.lit(9).cast("long"), _floor(gap(x["hi"]), step))
        return F.when(up == down, x["base"] + up * step)

    each = F.array(F.struct(base.alias("base"), after.alias("after"), _col(lo).cast("long").alias("lo"), _col(hi).cast("long").alias("hi")))
    return F.when(damaged, F.get(F.transform(each, digit), F.lit(0)))


def _floor(a: Column, b: Column) -> Column:
    """a div b, rounded down, for b above 0."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def _ceil(a: Column, b: Column) -> Column:
    return -_floor(-a, b)


def period_key(ts, weekly: bool = True) -> Column:
    """ISO week '2026-W33', or the date, of a timestamp in its own zone."""
    t = _col(ts)
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t)) if weekly else F.date_format(t, "yyyy-MM-dd")


def version_name(c) -> Column:
    return F.regexp_extract(_col(c), r"versionName=(\S+)", 1)


def within(v, lo, hi) -> Column:
    """Inclusive bounds; a missing end is open."""
    return _col(v).between(F.coalesce(_col(lo), F.lit(0)), F.coalesce(_col(hi), F.lit(2**63 - 1)))


def near(got, want, tolerance: float = 0.01) -> Column:
    """Within the tolerance of a wanted value; a wanted 0 must be met exactly."""
    g, w = _col(got), _col(want)
    return F.when(w == 0, g == 0).otherwise(F.abs(g - w) / w <= tolerance)


def backoff(cadence, failures, most: int = 5) -> Column:
    """cadence * (2 ** min(failures, most) - 1), 0 without failures."""
    f = _col(failures)
    return F.when(f <= 0, 0).otherwise(_col(cadence) * (F.pow(F.lit(2.0), F.least(f, F.lit(most))).cast("long") - 1)).cast("long")


def null_if_zero(c) -> Column:
    return F.nullif(_col(c), F.lit(0))


def clamp(c, lo=0.0, hi=1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _col(c)))


def expected_label(total) -> Column:
    """A group's total as text, '?' while it is unknown."""
    return F.coalesce(_col(total).cast("string"), F.lit("?"))


def listed_devices(text) -> Column:
    """Serials in a device listing that are ready: lines of a serial, white space and the word device, behind the heading."""
    every = F.split(_col(text), "\n")
    lines = F.slice(every, F.lit(2), F.size(every))
    return F.transform(F.filter(lines, lambda x: x.rlike(r"^\S+\s+device(\s|\z)")), lambda x: F.regexp_extract(x, r"^(\S+)", 1))


def field_rect(y0, y1, height, x0: float, x1: float, top: float, bottom: float) -> Column:
    """struct of fractions of the frame: columns x0 to x1, and rows between two fractions of the band from y0 to y1."""
    at = lambda f: (_col(y0) + (_col(y1) - _col(y0)) * F.lit(f)) / _col(height)
    return F.struct(F.lit(x0).alias("x1"), at(top).alias("y1"), F.lit(x1).alias("x2"), at(bottom).alias("y2"))


def padded(x1, y1, x2, y2, pad: float) -> Column:
    """A rectangle grown by a margin on each side, kept within the frame."""
    return F.struct(clamp(_col(x1) - pad).alias("x1"), clamp(_col(y1) - pad).alias("y1"), clamp(_col(x2) + pad).alias("x2"), clamp(_col(y2) + pad).alias("y2"))


def jitter(least: float, most: float, seed: int | None = None) -> Column:
    """Uniform between two bounds; for pauses, not for queries, as a rerun without a seed differs."""
    return F.lit(least) + (F.rand(seed) if seed is not None else F.rand()) * (most - least)


def valid_rect(x1, y1, x2, y2) -> Column:
    return (_col(x1) >= 0) & (_col(y1) >= 0) & (_col(x2) <= 1) & (_col(y2) <= 1) & (_col(x1) < _col(x2)) & (_col(y1) < _col(y2))
