"""Days since an epoch, decimal years and months, day-of-year variants, month calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1850-01-01"


def day_number(t: Column, epoch: str = EPOCH) -> Column:
    """Whole days from the epoch."""
    return F.datediff(t, F.lit(epoch).cast("date"))


def decimal_day(t: Column, epoch: str = EPOCH) -> Column:
    """Days from the epoch with the fraction of the day."""
    t = t.cast("timestamp")
    return day_number(t, epoch) + (F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))) / F.lit(86_400_000_000.0)


def seconds_since(t: Column, epoch: str = EPOCH) -> Column:
    return F.unix_seconds(t.cast("timestamp")) - F.unix_seconds(F.lit(epoch).cast("timestamp"))


def date_of(day: Column, epoch: str = EPOCH) -> Column:
    return F.date_add(F.lit(epoch).cast("date"), day)


def decimal_year(t: Column) -> Column:
    """Year plus the elapsed share of its seconds."""
    t = t.cast("timestamp")
    start = F.date_trunc("year", t)
    after = start + F.expr("INTERVAL 1 YEAR")
    return F.year(t) + (F.unix_micros(t) - F.unix_micros(start)) / (F.unix_micros(after) - F.unix_micros(start))


def decimal_month(t: Column, epoch_year: int = 1850) -> Column:
    """Months from the start of the epoch's year, plus the elapsed share of the month."""
    t = t.cast("timestamp")
    start = F.date_trunc("month", t)
    after = start + F.expr("INTERVAL 1 MONTH")
    return (F.year(t) - epoch_year) * 12 + F.month(t) - 1 + (F.unix_micros(t) - F.unix_micros(start)) / (F.unix_micros(after) - F.unix_micros(start))


def month_days(reference: Column, offset: Column) -> Column:
    """Array of all dates of the month ``offset`` months after the reference's."""
    first = F.add_months(F.trunc(reference, "month"), offset)
    return F.sequence(first, F.last_day(first), F.expr("INTERVAL 1 DAY"))


def month_count(start: Column, end: Column) -> Column:
    """Months from one date's month to another's, both included."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1


def model_day_of_year(d: Column) -> Column:
    """Day of year without 29 February: from day 60 of a leap year on, one less."""
    n, y = F.dayofyear(d), F.year(d)
    leap = ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0)) | (F.pmod(y, F.lit(400)) == 0)
    return F.when(leap & (n > 59), n - 1).otherwise(n)


def pentad(day_of_year: Column) -> Column:
    return (F.ceil(day_of_year / 5) - 1).cast("int")


def season_angles(t: Column, harmonics: int) -> list[tuple[str, Column]]:
    """Named sine and cosine of each harmonic of the decimal year."""
    y = decimal_year(t)
    return [x for k in range(1, harmonics + 1) for x in ((f"sin_{k}", F.sin(2 * F.pi() * k * y)), (f"cos_{k}", F.cos(2 * F.pi() * k * y)))]


def pattern_dates(name: Column, regex: str, layout: str) -> Column:
    """Time read from a file name: the regex's groups joined, parsed by the layout."""
    groups = layout.count("'") // 2 if "'" in layout else None
    text = F.regexp_extract(name, regex, 1) if groups is None else F.regexp_extract(name, regex, 0)
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(layout))
