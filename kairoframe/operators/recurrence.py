"""Recurrence rules: expansion on date arrays, exclusions, limits and RFC 5545 text.

A rule is a set of columns on each row; its occurrences are a filtered date sequence between an anchor
and a horizon, so expansion is an array expression and one explode, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.functions.civil import monday

from .periods import outside

DAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]


def days(start: Column, end: Column) -> Column:
    """The dates from start to end, both included."""
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(F.expr("cast(array() as array<date>)"))


def weekly(anchor: Column, end: Column, on: list[int], interval: int = 1) -> Column:
    """Dates on these weekdays (0 Monday) in every interval-th week from the anchor's."""
    weeks = lambda d: F.floor(F.datediff(monday(d), monday(anchor)) / 7)
    return F.filter(days(anchor, end), lambda d: F.weekday(d).isin(on) & (weeks(d) % interval == 0))


def months_between(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def monthly(anchor: Column, end: Column, month_days: list[int], interval: int = 1) -> Column:
    """Dates on these days of the month (negative from its end) in every interval-th month."""
    from_end = lambda d: F.dayofmonth(d) - F.dayofmonth(F.last_day(d)) - 1
    return F.filter(days(anchor, end), lambda d: (F.dayofmonth(d).isin(month_days) | from_end(d).isin(month_days)) & (months_between(anchor, d) % interval == 0))


def months(start: Column, end: Column) -> Column:
    """The firsts of the months from the one of start to the one of end."""
    return F.when(start <= end, F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))).otherwise(F.expr("cast(array() as array<date>)"))


def nth_on(first: Column, on: list[int], nth: int) -> Column:
    """The nth (negative: from the end) day of a month, given by its first, that falls on one of these weekdays; null without one."""
    weeks, place = divmod(abs(nth) - 1, len(on))
    edge = first if nth > 0 else F.last_day(first)
    away = lambda d: F.pmod((d - F.weekday(edge)) if nth > 0 else (F.weekday(edge) - d), F.lit(7))
    steps = F.get(F.array_sort(F.array(*[away(F.lit(d)) for d in sorted(set(on))])), F.lit(place)) + 7 * weeks
    found = F.date_add(edge, steps if nth > 0 else -steps)
    return F.when(F.trunc(found, "month") == first, found)


def positions(anchor: Column, end: Column, on: list[int], nth: int) -> Column:
    """The nth (negative: from the end) of the dates of each month that fall on these weekdays."""
    on = sorted(set(on))
    return F.filter(F.transform(months(anchor, end), lambda m: nth_on(m, on, nth)), lambda d: (d >= anchor) & (d <= end))


def yearly(anchor: Column, end: Column, month: int, day: int) -> Column:
    return F.filter(days(anchor, end), lambda d: (F.month(d) == month) & (F.dayofmonth(d) == day))


def times_per_week(n: int, first: str = "MO") -> list[int]:
    """The weekdays that n times a week are spread over, from the first day of the week (MO or SU)."""
    if not 1 <= n <= 7:
        raise ValueError("one to seven times a week")
    return [(i * 7 // n + (6 if first == "SU" else 0)) % 7 for i in range(n)]


def times_per_day(n: int) -> list[int]:
    """The hours that n times a day are spread over."""
    if not 1 <= n <= 24:
        raise ValueError("one to twenty-four times a day")
    return [i * 24 // n for i in range(n)]


def hourly(start: Column, end: Column, interval: int = 1, hours: list[int] | None = None, on: list[int] | None = None) -> Column:
    """Wall clocks every interval-th hour from start to end, both included, at these hours and on these weekdays."""
    steps = F.when(start <= end, F.sequence(start, end, F.expr(f"interval {int(interval)} hours"))).otherwise(F.expr("cast(array() as array<timestamp_ntz>)"))
    keep = lambda t: (F.lit(True) if hours is None else F.hour(t).isin(hours)) & (F.lit(True) if on is None else F.weekday(t).isin(on))
    return F.filter(steps, keep)


def at_hours(dates: Column, hours: list[int]) -> Column:
    """Wall clocks at these hours of each date."""
    return F.flatten(F.transform(dates, lambda d: F.array(*[F.timestamp_add("HOUR", F.lit(h), d.cast("timestamp_ntz")) for h in sorted(hours)])))


def seeded(candidates: Callable[[Column], Column], start: Column, excluded: Callable[[Column], Column]) -> Column:
    """The first date from start on that a rule gives and no exclusion takes, within eight years; it is what intervals count from."""
    days_ = candidates(F.date_add(start, 366 * 8 - 1))
    return F.get(F.filter(days_, lambda d: (d >= start) & ~excluded(d)), F.lit(0))


def counted(dates: Column, excluded: Callable[[Column], Column], count: int, cutoff: Column) -> Column:
    """The first `count` dates that aren't excluded, of which those from the cutoff on are shown."""
    return F.filter(F.slice(F.filter(dates, lambda d: ~excluded(d)), 1, count), lambda d: d >= cutoff)


def excluded_weekdays(start: int, end: int) -> list[int]:
    """The weekdays from one to another, over the week's end where they must."""
    return [(start + i) % 7 for i in range((end - start) % 7 + 1)]


def is_ordinal(day: Column, weekday: int, nth: int) -> Column:
    """Is a date the nth (negative: from the end) such weekday of its month?"""
    place = F.ceil(F.dayofmonth(day) / 7) if nth > 0 else F.ceil((F.dayofmonth(F.last_day(day)) - F.dayofmonth(day) + 1) / 7)
    return (F.weekday(day) == weekday) & (place == abs(nth))


def occurrences(df: DataFrame, key: str, dates: Column, limit: int, count: int | None = None) -> DataFrame:
    """One row an occurrence: (key, seq from 1, day, truncated); at most `limit` a row, `count` ends the rule."""
    dates = F.slice(dates, 1, count) if count else dates
    rows = df.select(key, F.slice(dates, 1, limit).alias("_d"), (F.size(dates) > limit).alias("truncated"))
    return rows.select(key, F.posexplode("_d").alias("seq", "day"), "truncated").withColumn("seq", F.col("seq") + 1)


def without(occ: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Occurrences that lie in no period [from_day, to_day) of exclusions, which may overlap."""
    return outside(occ, exclusions, [])


def top(occ: DataFrame, by: str, order: list[str], limit: int, parts: int = 32) -> DataFrame:
    """The first occurrences of each key, with whether there were more.

    Each key's rows are dealt to parts, of which the first `limit` and one more go on, so no task orders
    all rows of a key.
    """
    rows = occ.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    some = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).where(F.col("_r") <= limit + 1)
    w = Window.partitionBy(by)
    ranked = some.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count("*").over(w) > limit)
    return ranked.where(F.col("rank") <= limit).drop("_part", "_r")


def rrule(
    start: Column, freq: str, interval: int = 1, by_day: list[str] | None = None, by_month_day: list[int] | None = None, by_set_pos: list[int] | None = None,
    count: int | None = None, until: Column | None = None, zone: str | None = None, end: Column | None = None, week_start: str = "MO", by_month: list[int] | None = None,
    by_hour: list[int] | None = None, excluded: Column | None = None,
) -> Column:
    """The iCalendar text of a rule: all-day where no zone is given, else of wall clocks in it.

    `until` is the last day, or the last instant of a timed rule; `excluded` an array of dates or wall clocks
    left out, which a count is raised by; lines are DTSTART, DTEND, RRULE, EXDATE.
    """
    pattern = "yyyyMMdd" if zone is None else "yyyyMMdd'T'HHmmss"
    kind = "VALUE=DATE" if zone is None else f"TZID={zone}"
    line = lambda name, value: F.concat(F.lit(f"{name};{kind}:"), F.date_format(value, pattern))
    parts = [F.lit(f"RRULE:FREQ={freq};INTERVAL={interval}")]
    if week_start == "SU":
        parts.append(F.lit("WKST=SU"))
    for name, values in (("BYDAY", by_day), ("BYMONTH", by_month), ("BYMONTHDAY", by_month_day), ("BYSETPOS", by_set_pos), ("BYHOUR", by_hour)):
        if values:
            parts.append(F.lit(f"{name}={','.join(map(str, values))}"))
    if count:
        parts.append(F.concat(F.lit("COUNT="), F.lit(count) + (F.lit(0) if excluded is None else F.coalesce(F.size(excluded), F.lit(0)))))
    if until is not None:
        parts.append(F.concat(F.lit("UNTIL="), F.date_format(until, pattern if zone is None else "yyyyMMdd'T'HHmmss'Z'")))
    lines = [line("DTSTART", start)] + ([] if end is None else [line("DTEND", end)]) + [F.concat_ws(";", *parts)]
    if excluded is not None:
        left_out = F.array_join(F.transform(excluded, lambda d: F.date_format(d, pattern)), ",")
        lines.append(F.when(F.size(excluded) > 0, F.concat(F.lit(f"EXDATE;{kind}:"), left_out)))
    return F.concat_ws("\n", *lines)
