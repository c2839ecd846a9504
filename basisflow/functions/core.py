"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that stand for a missing text
NULL_WORDS = ("", "nan", "none", "<na>", "unknown")


def clip(x: Column, lo: float, hi: float) -> Column:
    """x held inside [lo, hi]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def ratio_minus_one(a: Column, b: Column) -> Column:
    """a / b - 1, zero where b is (nearly) zero or a side is missing."""
    return F.coalesce(F.when(F.abs(b) > 1e-12, a / b - 1), F.lit(0.0))


def null_text(c: Column) -> Column:
    """Text with the usual spellings of a missing value turned into NULL."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*NULL_WORDS), t)


def half_away(x: Column) -> Column:
    """Round halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def half_even(x: Column) -> Column:
    return F.rint(x)


def short_sha1(n: int, *parts: Column) -> Column:
    """First n hex digits of the SHA-1 of the parts joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha1(text.cast("binary")), 1, n)


def uniform_bits(*parts: Column) -> Column:
    """A reproducible draw in [0, 2**60) from the parts: 15 hex digits of an MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def uniform_int(lo: int, hi: int, *parts: Column) -> Column:
    """A reproducible integer draw from lo..hi, both included."""
    return (uniform_bits(*parts) % F.lit(hi - lo + 1) + F.lit(lo)).cast("long")


def hex_number(text: Column, digits: int) -> Column:
    """Hex digits as a whole number, in the same order. Numbers, unlike texts, let a hash aggregate find extremes without a sort."""
    part = lambda at, n: F.conv(F.substring(text, at, n), 16, 10).cast("long").cast("decimal(20,0)")
    low = digits - 15
    return part(1, digits) if low <= 0 else (part(1, 15) * F.lit(16 ** low) + part(16, low)).cast("decimal(38,0)")


def hex_text(number: Column, digits: int) -> Column:
    """The lower-case hex digits of ``hex_number``."""
    part = lambda x, n: F.lower(F.lpad(F.hex(x.cast("long")), n, "0"))
    low = digits - 15
    if low <= 0:
        return part(number, digits)
    rest = number % F.lit(16 ** low)
    return F.concat(part((number - rest) / F.lit(16 ** low), 15), part(rest, low))


def to_day(c: Column) -> Column:
    """Calendar day of a date text or timestamp; NULL when it cannot be read."""
    return F.to_date(F.try_to_timestamp(c.cast("string")))


# proleptic Gregorian ordinal of 1970-01-01
EPOCH_ORDINAL = 719163


def to_ordinal(d: Column) -> Column:
    return F.unix_date(d) + F.lit(EPOCH_ORDINAL)


def from_ordinal(n: Column) -> Column:
    return F.date_from_unix_date((n - F.lit(EPOCH_ORDINAL)).cast("int"))


def to_yyyymmdd(d: Column) -> Column:
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def from_yyyymmdd(n: Column) -> Column:
    return F.make_date((n / 10000).cast("int"), ((n % 10000) / 100).cast("int"), (n % 100).cast("int"))


def any_day_number(n: Column) -> Column:
    """A day from a yyyymmdd number, an ordinal or days since 1970, told apart by size."""
    return (F.when(n >= 10_000_000, from_yyyymmdd(n))
            .when(n >= 500_000, from_ordinal(n))
            .otherwise(F.date_from_unix_date(n.cast("int"))))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def file_safe(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_")
