"""Times as pairs of epoch seconds: parsing, interval relations and durations.

A point in time is an interval whose bounds are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """Two DOUBLE columns."""

    begin: Column
    end: Column

    @staticmethod
    def of(begin: float | Column | str, end: float | Column | str | None = None) -> Interval:
        one = lambda v: F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))
        return Interval(one(begin), one(begin if end is None else end))


def overlaps(a: Interval, b: Interval) -> Column:
    """Any common time, bounds included."""
    return (a.begin <= b.end) & (a.end >= b.begin)


def during(a: Interval, b: Interval) -> Column:
    """True when a encloses b, bounds included: the sense this name has in the data model (see allen_during for the usual one)."""
    return (a.begin <= b.begin) & (a.end >= b.end)


def allen_during(a: Interval, b: Interval) -> Column:
    return (a.begin > b.begin) & (a.end < b.end)


def allen_overlaps(a: Interval, b: Interval) -> Column:
    return (a.begin < b.begin) & (a.end > b.begin) & (a.end < b.end)


def before(a: Interval, b: Interval) -> Column:
    return a.end < b.begin


def after(a: Interval, b: Interval) -> Column:
    return before(b, a)


def meets(a: Interval, b: Interval) -> Column:
    return a.end == b.begin


def starts(a: Interval, b: Interval) -> Column:
    return (a.begin == b.begin) & (a.end <= b.end)


def finishes(a: Interval, b: Interval) -> Column:
    return (a.end == b.end) & (a.begin >= b.begin)


def equal(a: Interval, b: Interval) -> Column:
    return (a.begin == b.begin) & (a.end == b.end)


def inverse(relation):
    """The relation with its sides exchanged: overlaps, during, meets, starts and finishes have one each."""
    return lambda a, b: relation(b, a)


overlaps_inverse, during_inverse, meets_inverse = inverse(overlaps), inverse(during), inverse(meets)
starts_inverse, finishes_inverse = inverse(starts), inverse(finishes)


def expand_before(t: Interval, margin: float) -> Interval:
    return Interval(t.begin - margin, t.end)


def expand_after(t: Interval, margin: float) -> Interval:
    return Interval(t.begin, t.end + margin)


def expand(t: Interval, margin: float) -> Interval:
    return Interval(t.begin - margin, t.end + margin)


def duration(t: Interval) -> Column:
    return t.end - t.begin


def duration_before(t: Interval, seconds: float) -> Interval:
    return Interval(t.begin - seconds, t.begin - seconds)


def duration_after(t: Interval, seconds: float) -> Interval:
    return Interval(t.end + seconds, t.end + seconds)


def signed_duration(a: Interval, b: Interval) -> Column:
    """From a's begin to b's end if a is before b, else the negative of the same from b to a."""
    return F.when(before(a, b), b.end - a.begin).otherwise(-(a.end - b.begin))


def signed_between(a: Interval, b: Interval) -> Column:
    """From a's end to b's begin if a is before b, else the negative of the same from b to a."""
    return F.when(before(a, b), b.begin - a.end).otherwise(-(a.begin - b.end))


def parse_timestamp(text: Column, offset: float = 0.0) -> Column:
    """Epoch seconds less offset of a number, an ISO-8601 time, or TIMEX2/TIMEX3 XML; null if it is none of these."""
    plain = F.trim(text)
    xml = F.when(plain.startswith("<"), F.coalesce(F.nullif(F.regexp_extract(plain, r'(?i)<(?:\w+:)?timex2\b[^>]*\bVAL="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(plain, r'(?i)<(?:\w+:)?timex3\b[^>]*\bvalue="([^"]*)"', 1), F.lit(""))))
    iso = F.coalesce(xml, plain)
    number = F.when(iso.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$") & ~iso.rlike(r"^[0-9]{4}$"), iso.try_cast("double"))
    stamp = F.try_to_timestamp(F.when(iso.rlike(r"^[0-9]{4}(-[0-9]{2}|$)"), iso))
    return F.coalesce(number, F.unix_micros(stamp) / 1e6) - offset


def format_timestamp(epoch: Column) -> Column:
    """ISO 8601 in UTC, to the second.  The session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(epoch)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def timestamp_duration(seconds: Column) -> Column:
    """Years, months, days, hours, minutes, seconds from 1970-01-01 to |seconds| after it, field by field without borrowing."""
    t = F.abs(seconds)
    at = F.timestamp_seconds(F.floor(t))
    part = lambda f, zero, name: (f(at) - zero).alias(name)
    return F.struct(part(F.year, 1970, "years"), part(F.month, 1, "months"), part(F.dayofmonth, 1, "days"), part(F.hour, 0, "hours"), part(F.minute, 0, "minutes"), (t - F.floor(t / 60) * 60).alias("seconds"))


_DURATION = r"^P(\d+)Y(\d+)M(\d+)DT(\d+)H(\d+)M(\d+(?:\.\d+)?)S$"


def parse_duration(text: Column) -> Column:
    """The six fields of PyYmMdDThHmMsS; null otherwise."""
    names = ("years", "months", "days", "hours", "minutes")
    part = [F.regexp_extract(text, _DURATION, i + 1).try_cast("int").alias(n) for i, n in enumerate(names)]
    return F.when(text.rlike(_DURATION), F.struct(*part, F.regexp_extract(text, _DURATION, 6).try_cast("double").alias("seconds")))


def format_duration(d: Column) -> Column:
    seconds = F.when(d["seconds"] == F.floor(d["seconds"]), d["seconds"].cast("long").cast("string")).otherwise(d["seconds"].cast("string"))
    return F.concat(F.lit("P"), d["years"], F.lit("Y"), d["months"], F.lit("M"), d["days"], F.lit("DT"), d["hours"], F.lit("H"), d["minutes"], F.lit("M"), seconds, F.lit("S"))
