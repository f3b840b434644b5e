"""Date specifications to periods: the kinds a schedule's day may have, as one struct column against a reference.

A specification has `kind` and the fields that its kind takes, the others null. Its periods are an array of
(start, end), the end exclusive and null for one day or moment; a specification that names no such date gives
an empty array, a null one today. Years of a lunar or named day come from the array of its dates (`dates.named_days`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairoframe.functions import civil
from kairoframe.functions.text import let

from . import dates

SPEC = (
    "struct<kind:string,offset:int,days:array<int>,modifier:string,distance:int,group:string,year:int,month:int,day:int,to_year:int,to_month:int,to_day:int,"
    "edge:string,week:int,unit:string,ordinal:int,weekday:int,until_weekday:int>"
)
PERIOD = "array<struct<start:timestamp_ntz,end:timestamp_ntz>>"
CLOCK_UNITS = ["hour", "minute", "second"]


def spec(**fields: Column) -> Column:
    """A specification from the fields that are given."""
    kinds = dict(part.split(":") for part in SPEC[len("struct<") : -1].split(","))
    if unknown := set(fields) - set(kinds):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return F.struct(*[(fields[n] if n in fields else F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])


def period(start: Column, end: Column | None = None) -> Column:
    """An array of one period, empty where it has no start."""
    one = F.struct(start.cast("timestamp_ntz").alias("start"), (F.lit(None) if end is None else end).cast("timestamp_ntz").alias("end"))
    return F.filter(F.array(one), lambda p: p["start"].isNotNull())


def made(year: Column, month: Column, day: Column) -> Column:
    """A date, null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def calendar(s: Column, today: Column) -> Column:
    """Fields that are missing are the reference's, the day the first; what is past without a year is the next such date."""
    day = F.coalesce(s["day"], F.lit(1))
    named = made(F.coalesce(s["year"], F.year(today)), F.coalesce(s["month"], F.month(today)), day)
    later = F.when(s["month"].isNull(), F.add_months(today, 1)).otherwise(F.add_months(today, 12))
    again = made(F.year(later), F.coalesce(s["month"], F.month(later)), day)
    return period(F.when(s["year"].isNull() & (named < today), again).otherwise(named))


def calendar_period(s: Column, today: Column) -> Column:
    """A month, its first or last day, or its nth seven days."""
    now = F.month(today)
    step = F.when((s["modifier"] == "next") & (s["month"] <= now), 1).when((s["modifier"] == "last") & (s["month"] >= now), -1).otherwise(0)
    first = made(F.coalesce(s["year"], F.year(today) + step), s["month"], F.lit(1))
    over = s["year"].isNull() & s["modifier"].isNull() & (F.add_months(first, 1) <= today)
    first = F.when(over, F.add_months(first, 12)).otherwise(first)

    def of_month(m: Column) -> Column:
        start, end = civil.week_of_month(m, s["week"])
        return F.when(s["edge"] == "start", period(m)).when(s["edge"] == "end", period(F.last_day(m))).when(s["week"].isNotNull(), period(start, end)).otherwise(period(m, F.add_months(m, 1)))

    return let(first, of_month)


def relative_unit(s: Column, reference: Column, week_start: str) -> Column:
    """The unit that lies so many steps from the reference's, or an edge of it."""
    steps = F.when(s["modifier"] == "next", 1).when(s["modifier"] == "last", -1).otherwise(0) * F.coalesce(s["distance"], F.lit(1))
    out = F.lit(None).cast(PERIOD)
    for unit in ("second", "minute", "hour", "day", "week", "month", "year"):
        first = civil.week_start(reference.cast("date"), week_start).cast("timestamp_ntz") if unit == "week" else F.date_trunc(unit, reference).cast("timestamp_ntz")
        at = lambda n, u=unit, f=first: F.timestamp_add(u.upper(), n, f)
        last = F.timestamp_add("SECOND", F.lit(-1), at(steps + 1)) if unit in CLOCK_UNITS else F.timestamp_add("DAY", F.lit(-1), at(steps + 1))
        own = F.when(s["edge"] == "start", period(at(steps))).when(s["edge"] == "end", period(last)).otherwise(period(at(steps), at(steps + 1)))
        out = F.when(s["unit"] == unit, own).otherwise(out)
    return out


def ordinal_weekday(s: Column, today: Column) -> Column:
    """The nth weekday of a month: the one of the fields, or one relative to the reference's month or year."""
    steps = F.when(s["modifier"] == "next", 1).when(s["modifier"] == "last", -1).otherwise(0) * F.coalesce(s["distance"], F.lit(1))
    relative = F.when(s["unit"] == "year", F.add_months(F.trunc(today, "year"), steps * 12)).when(s["unit"] == "month", F.add_months(F.trunc(today, "month"), steps))
    fixed = made(F.coalesce(s["year"], F.year(today)), F.coalesce(s["month"], F.month(today)), F.lit(1))
    return period(F.when(s["ordinal"] != 0, civil.ordinal_weekday(F.coalesce(relative, fixed), s["weekday"], s["ordinal"])))


def calendar_range(s: Column, today: Column) -> Column:
    """From one date to another, whose missing fields are the first's; over the year's end where its month is earlier."""
    start = made(F.coalesce(s["year"], F.year(today)), F.coalesce(s["month"], F.month(today)), F.coalesce(s["day"], F.lit(1)))
    to_day = F.coalesce(s["to_day"], F.lit(1))
    end = made(F.coalesce(s["to_year"], F.year(start)), F.coalesce(s["to_month"], F.month(start)), to_day)
    wrapped = made(F.year(start) + 1, s["to_month"], to_day)
    end = F.when((end < start) & s["to_year"].isNull() & s["to_month"].isNotNull(), wrapped).otherwise(end)
    over = s["year"].isNull() & s["to_year"].isNull() & (F.date_add(end, 1) <= today)
    shift = lambda d: F.when(over, F.add_months(d, 12)).otherwise(d)
    return period(F.when(end >= start, shift(start)), F.date_add(shift(end), 1))


def resolve_dates(s: Column, reference: Column, named: Column | None = None, week_start: str = "MO", bare: str = "next", following: str = "calendar") -> Column:
    """The periods of a specification at a reference wall clock; policies as `civil.weekday_near` takes them."""
    reference = reference.cast("timestamp_ntz")
    today = reference.cast("date")
    distance = F.coalesce(s["distance"], F.lit(1))
    near = lambda w: civil.weekday_near(today, w, s["modifier"], week_start, bare, following, distance)
    listed = lambda ds: F.transform(ds, lambda d: F.struct(d.cast("timestamp_ntz").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end")))
    bare_first = civil.weekday_near(today, s["weekday"], F.lit(None).cast("string"), week_start, bare, following)
    length = F.pmod(s["until_weekday"] - s["weekday"], F.lit(7)) + 1
    group = F.when(s["group"] == "weekend", F.array(F.lit(5), F.lit(6))).otherwise(F.array(*[F.lit(i) for i in range(5)]))
    lead = F.when(s["group"] == "weekend", 5).otherwise(0)
    begin = civil.weekday_near(today, lead, F.lit("this"), week_start)
    upcoming = F.lit(following == "immediate") & (begin > today)
    moved = F.when(s["modifier"] == "last", -7 - 7 * (distance - 1)).when(s["modifier"] == "next", F.when(upcoming, 0).otherwise(7) + 7 * (distance - 1)).otherwise(0)
    grouped = F.when(s["modifier"].isNull(), F.transform(group, near)).otherwise(F.transform(group, lambda w: F.date_add(begin, moved + w - lead)))
    out = F.when(s.isNull() | s["kind"].isNull(), period(today)).when(s["kind"] == "now", period(reference)).when(s["kind"] == "relativeDay", period(F.date_add(today, s["offset"])))
    out = out.when(s["kind"] == "weekday", listed(F.transform(s["days"], near))).when(s["kind"] == "weekdayRange", period(bare_first, F.date_add(bare_first, length)))
    out = out.when(s["kind"] == "dayGroup", listed(grouped)).when(s["kind"] == "calendar", calendar(s, today)).when(s["kind"] == "calendarPeriod", calendar_period(s, today))
    out = out.when(s["kind"] == "relativeUnit", relative_unit(s, reference, week_start)).when(s["kind"] == "ordinalWeekday", ordinal_weekday(s, today)).when(s["kind"] == "calendarRange", calendar_range(s, today))
    if named is not None:
        out = out.when(s["kind"].isin("holiday", "lunar"), period(dates.next_named(named, today, s["year"])))
    return F.coalesce(out, F.expr(f"cast(array() as {PERIOD})"))
