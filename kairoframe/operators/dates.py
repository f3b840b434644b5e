"""Named days as a small dimension, and the dates that calendar fields stand for.

Holidays and lunar dates of a span of years are one table of a fixed size (some 700 keys), keyed by a
holiday's name, by "L:month-day", by "L:month-day-leap" or, for a day of any lunar month, by "L:*-day".
Each row has the dates of its key with their years, so texts meet it by one equality and take the next
date from the array: no range join.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairoframe.functions.lexicon import LUNAR_HOLIDAYS, SOLAR_HOLIDAYS, lookup
from kairoframe.functions.lunar import lunar_months


def lunar_days(spark: SparkSession, first: int = 1900, last: int = 2100) -> DataFrame:
    """(year, month, day, leap, date) of every lunar day of these lunar years."""
    months = lunar_months(spark, first, last)
    rows = months.select("year", "month", "leap", "start_jdn", F.explode(F.sequence(F.lit(1), "length")).alias("day"))
    return rows.select("year", "month", "day", "leap", F.date_from_unix_date(F.col("start_jdn") + F.col("day") - 2440589).alias("date"))


def to_solar(rows: DataFrame, days: DataFrame, year: str, month: str, day: str, leap: str) -> DataFrame:
    """Append `solar`, the date of a lunar one: the ordinary month's where the leap month is absent, null without that day."""
    keyed = days.select(F.col("year").alias("_y"), F.col("month").alias("_m"), F.col("day").alias("_d"), "leap", "date")
    both = keyed.groupBy("_y", "_m", "_d").agg(F.max(F.when(~F.col("leap"), F.col("date"))).alias("_plain"), F.max(F.when(F.col("leap"), F.col("date"))).alias("_leap"))
    has_leap = keyed.where("leap").groupBy("_y", "_m").agg(F.lit(True).alias("_has"))
    both = both.join(has_leap, ["_y", "_m"], "left")
    joined = rows.join(both, (F.col(year) == F.col("_y")) & (F.col(month) == F.col("_m")) & (F.col(day) == F.col("_d")), "left")
    use = F.col(leap) & F.coalesce(F.col("_has"), F.lit(False))
    return joined.withColumn("solar", F.when(use, F.col("_leap")).otherwise(F.col("_plain"))).drop("_y", "_m", "_d", "_plain", "_leap", "_has")


def named_days(spark: SparkSession, first: int = 1900, last: int = 2100) -> DataFrame:
    """(day_key, days): the dates of each key as an array of (date, year), ascending."""
    days = lunar_days(spark, first, last).withColumn("leap_of", F.max(F.when(F.col("leap"), F.col("month"))).over(Window.partitionBy("year")))
    m, d, plain = F.col("month").cast("string"), F.col("day").cast("string"), ~F.col("leap")
    entry = lambda name, day="date": F.struct(name.alias("day_key"), F.col(day).alias("date"), F.col("year"))
    feast = lookup({f"{a}-{b}": name for name, (a, b) in LUNAR_HOLIDAYS.items()}, F.concat(m, F.lit("-"), d))
    keys = [
        F.when(plain, entry(F.concat(F.lit("L:"), m, F.lit("-"), d))),
        F.when(~plain | ~F.col("leap_of").eqNullSafe(F.col("month")), entry(F.concat(F.lit("L:"), m, F.lit("-"), d, F.lit("-leap")))),
        entry(F.concat(F.lit("L:*-"), d)),
        F.when(plain & feast.isNotNull(), entry(feast)),
        F.when(plain & (m == "1") & (d == "1"), entry(F.lit("tet-eve"), "eve")),
    ]
    keyed = days.withColumn("eve", F.date_sub("date", 1)).select(F.inline(F.array_compact(F.array(*keys))))
    solar = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("m"), F.lit(b).alias("d")) for n, (a, b) in SOLAR_HOLIDAYS.items()])
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"), F.explode(solar).alias("h"))
    keyed = keyed.union(years.select("h.n", F.make_date("year", "h.m", "h.d"), "year"))
    return keyed.groupBy("day_key").agg(F.array_sort(F.collect_list(F.struct("date", "year"))).alias("days"))


def next_named(days: Column, today: Column, year: Column) -> Column:
    """Of a key's dates the one of the year if one is given, else the first on or after today."""
    of_year = F.filter(days, lambda x: x["year"] == year)
    ahead = F.filter(days, lambda x: x["date"] >= today)
    return F.when(year.isNotNull(), F.get(of_year, F.lit(0))["date"]).otherwise(F.get(ahead, F.lit(0))["date"])


def cycle_year(cycle: Column, near: Column) -> Column:
    """The year of that place in the cycle of sixty nearest to a year; of two as near, the later."""
    ahead = F.pmod(cycle - (near - 4), F.lit(60))
    return F.when(ahead <= 30, near + ahead).otherwise(near + ahead - 60)


def calendar_day(today: Column, year: Column, month: Column, day: Column) -> Column:
    """A date from the fields that are given: without a year the next such day, without a month the next such day of a month.

    Null where the fields form no date.
    """
    make = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    this = make(F.coalesce(year, F.year(today)), F.coalesce(month, F.month(today)), day)
    later = F.add_months(F.trunc(today, "month"), 1)
    after = F.when(month.isNotNull(), make(F.year(today) + 1, month, day)).otherwise(make(F.year(later), F.month(later), day))
    return F.when(year.isNull() & (this < today), after).otherwise(this)


def month_period(today: Column, year: Column, month: Column) -> tuple[Column, Column]:
    """First day and exclusive end of a month; without a year this year's, or the next one's where that is over."""
    first = F.make_date(F.coalesce(year, F.year(today)), month, F.lit(1))
    over = year.isNull() & (F.add_months(first, 1) <= today)
    first = F.when(over, F.add_months(first, 12)).otherwise(first)
    return first, F.add_months(first, 1)


def group_days(today: Column, group: Column, modifier: Column) -> Column:
    """The days of a weekend or of the weekdays: bare each next from today, else those of one week."""
    numbers = F.when(group == "weekend", F.array(F.lit(5), F.lit(6))).when(group == "weekday", F.array(*[F.lit(i) for i in range(5)]))
    week = F.when(modifier == "next", 7).when(modifier == "last", -7).otherwise(0)
    monday = F.date_add(today, -F.weekday(today))
    bare = F.transform(numbers, lambda i: F.date_add(today, F.pmod(i - F.weekday(today), F.lit(7))))
    return F.array_sort(F.when(modifier.isNull(), bare).otherwise(F.transform(numbers, lambda i: F.date_add(monday, i + week))))


def lunar_range(days: DataFrame, year: int, month: int, first: int, last: int) -> DataFrame:
    """(start, end): the solar days of a span of one lunar month's days, the end exclusive; no row where the month lacks the first.

    `days` is `lunar_days`; a last day that the month lacks is its last.
    """
    own = days.where((F.col("year") == year) & (F.col("month") == month) & ~F.col("leap") & F.col("day").between(first, last))
    out = own.agg(F.min(F.when(F.col("day") == first, F.col("date"))).alias("start"), F.date_add(F.max("date"), 1).alias("end"))
    return out.where("start is not null")


def checked_context(zone: str, limit: int = 30) -> None:
    """Raises ValueError for a zone that isn't known or a limit that isn't from 1 to 1000."""
    if zone not in available_timezones():
        raise ValueError(f"unknown zone {zone}")
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")


def horizon(reference: Column, until: Column | None = None, months: int = 12) -> Column:
    """The exclusive end of a preview: midnight of the day that is given, else so many months on."""
    return F.timestamp_add("MONTH", F.lit(months), reference) if until is None else F.coalesce(until.cast("timestamp_ntz"), F.timestamp_add("MONTH", F.lit(months), reference))


def weekly_if_bare(days: Column, modifier: Column, policy: str) -> Column:
    """The weekdays of a weekly rule where the policy for bare weekdays is `weekly` and none of them is modified, else null."""
    if policy not in ("next", "weekly"):
        raise ValueError("the policy for bare weekdays is next or weekly")
    return F.when(F.lit(policy == "weekly") & modifier.isNull() & (F.size(days) > 0), F.array_sort(days))
