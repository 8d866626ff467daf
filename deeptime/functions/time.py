"""Time arithmetic as column expressions: buckets, windows, years, calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from deeptime.functions import vocab as V


def lookup(col: Column, table: dict, default=None) -> Column:
    """``table[col]`` as a chain of comparisons, which stays in generated code."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(col == F.lit(k), F.lit(v)).otherwise(out)
    return out


def window_index(t: Column, window_s: Column) -> Column:
    """Window of an instant, towards minus infinity; 0 in single-window buckets."""
    return F.when(window_s == 0.0, F.lit(0).cast("bigint")).otherwise(F.floor(t / F.when(window_s != 0.0, window_s)))


def window_s(bucket: Column) -> Column:
    return lookup(bucket, dict(enumerate(V.WINDOW_S)))


def year_to_seconds(y: Column) -> Column:
    return (y - 1970.0) * V.YEAR_S


def seconds_to_year(t: Column) -> Column:
    return t / V.YEAR_S + 1970.0


def finest_bucket(precision: Column) -> Column:
    """Finest bucket of a precision label; null for an unknown label."""
    return lookup(precision, V.FINEST)


def precision_rank(precision: Column) -> Column:
    return lookup(precision, {p: i for i, p in enumerate(V.FINEST)})


def rank_label(rank: Column) -> Column:
    return lookup(rank, dict(enumerate(V.FINEST)))


#: Seconds that each label stands for, from coarse to fine.
LABEL_SECONDS = dict(zip(V.FINEST, [V.YEAR_S * 1e9, V.YEAR_S * 1e6, V.YEAR_S * 1e3, V.YEAR_S * 100, V.YEAR_S * 10, V.YEAR_S, V.YEAR_S / 12, 86400.0, 3600.0, 60.0, 1.0]))


def span_rank(span: Column) -> Column:
    """Rank of the finest label that is at least as long as ``span``."""
    out = F.lit(0)
    for i, s in enumerate(LABEL_SECONDS.values()):
        out = F.when(F.lit(s) >= span, i).otherwise(out)
    return out


def bucket_span(t0: Column, t1: Column, precision: Column, importance: Column) -> tuple[Column, Column]:
    """Coarsest and finest bucket in which an entity shows."""
    finest, span = finest_bucket(precision), t1 - t0
    deep = (F.abs(t0) > V.MAX_WINDOWED) | (F.abs(t1) > V.MAX_WINDOWED)
    high = reduce(lambda out, b: F.when((finest >= b) & (span / V.WINDOW_S[b] <= V.MAX_WINDOWS), b).otherwise(out), range(3, 14), F.least(finest, F.lit(2)))
    high = F.when(deep, F.least(finest, F.lit(2))).otherwise(high)
    low = reduce(lambda out, b: F.when(importance >= V.FLOOR[b], b).otherwise(out), range(12, -1, -1), F.lit(13))
    return F.least(low, high), high


def bucket_for_span(span: Column) -> Column:
    """Finest bucket that covers a visible span in ten windows."""
    out = F.when(span <= 2e16, 2).when(span <= 2e17, 1).otherwise(0)
    return reduce(lambda o, b: F.when(span <= V.WINDOW_S[b] * 10, b).otherwise(o), range(3, 14), out)


def julian_day(calendar: Column, y: Column, m: Column, d: Column) -> Column:
    """Julian Day Number in either calendar, for years from -4799 on."""
    a = F.expr("0") + F.floor((14 - m) / 12)
    yy = y.cast("bigint") + 4800 - a
    mm = m + 12 * a - 3
    base = d + F.floor((153 * mm + 2) / 5) + 365 * yy + F.floor(yy / 4)
    return F.when(calendar == "julian", base - 32083).otherwise(base - F.floor(yy / 100) + F.floor(yy / 400) - 32045).cast("bigint")


def day_seconds(jdn: Column) -> Column:
    return ((jdn - 2440588) * 86400).cast("double")


def gregorian_year(t: Column) -> Column:
    """Proleptic Gregorian year of an instant; null outside -4799..999999."""
    z = F.floor(t / 86400.0) + 719468  # days from 0000-03-01
    era = F.floor(z / 146097)
    doe = z - era * 146097
    yoe = F.floor((doe - F.floor(doe / 1460) + F.floor(doe / 36524) - F.floor(doe / 146096)) / 365)
    doy = doe - (365 * yoe + F.floor(yoe / 4) - F.floor(yoe / 100))
    year = yoe + era * 400 + F.when(doy >= 306, 1).otherwise(0)
    return F.when((F.abs(t) < 4e16) & year.between(-4799, 999999), year)


DRIFT = 2 * 86400.0 / V.YEAR_S


def census_year(t: Column, precision: Column) -> Column:
    """Year to which an instant counts: by the calendar for days and finer, else by the mean year."""
    exact = precision.isin("day", "hour", "minute", "second")
    mean = seconds_to_year(t)
    return F.when(exact, F.coalesce(gregorian_year(t).cast("double"), mean)).otherwise(F.floor(mean + DRIFT).cast("double")) + F.lit(0.0)


def census_slice(year: Column) -> tuple[Column, Column]:
    """Start and span of the census slice that holds a year."""
    span = F.when(F.abs(year) < 1e4, 100.0).when(F.abs(year) < 1e6, 1e4).when(F.abs(year) < 1e9, 1e6).otherwise(1e9)
    return F.floor(year / span) * span + F.lit(0.0), span


UNIT_YEARS = {6: 1000.0, 7: 100.0, 8: 10.0, 0: 1e9, 1: 1e8, 2: 1e7, 3: 1e6, 4: 1e5, 5: 1e4}
#: Label of each source precision.
SOURCE_LABEL = {0: "billion_year", 1: "billion_year", 2: "billion_year", 3: "million_year", 4: "million_year", 5: "million_year", 6: "millennium", 7: "century", 8: "decade", 9: "year", 10: "month", 11: "day", 12: "hour", 13: "minute", 14: "second"}


def days_in_month(calendar: Column, y: Column, m: Column) -> Column:
    leap = F.when(calendar == "julian", F.pmod(y, F.lit(4)) == 0).otherwise((F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0)))
    return F.when(m.isin(4, 6, 9, 11), 30).when(m != 2, 31).when(leap, 29).otherwise(28)
