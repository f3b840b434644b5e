"""Wall clocks, zones and calendar arithmetic as Column expressions.

Wall clocks are TIMESTAMP_NTZ. Sessions run in UTC, so an instant is a TIMESTAMP whose own rendering
is UTC. Where a wall clock falls in a gap it moves forward, where it occurs twice the earlier counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hours of the parts of a day; night ends on the next day.
PART_HOURS = {"morning": (6, 11), "noon": (11, 13), "afternoon": (13, 18), "evening": (18, 22), "night": (22, 5)}


def to_instant(wall: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(wall, zone)


def zone_kind(wall: Column, zone: Column) -> Column:
    """exact, gap (no instant has this wall clock) or overlap (two have)."""
    at = to_instant(wall, zone)
    back = F.from_utc_timestamp(at, zone)
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(at + hour, zone) == back) | (F.from_utc_timestamp(at - hour, zone) == back)
    return F.when(back != wall.cast("timestamp"), "gap").when(twice, "overlap").otherwise("exact")


def offset_minutes(at: Column, zone: Column) -> Column:
    return ((F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / 60).cast("int")


def iso(at: Column, zone: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss+hh:mm, UTC as +00:00."""
    off = offset_minutes(at, zone)
    sign = F.when(off < 0, "-").otherwise("+")
    return F.concat(
        F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad((F.abs(off) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(off) % 60).cast("string"), 2, "0")
    )


def instant(text: Column) -> Column:
    """An instant from ISO 8601 text that names its offset (Z or +hh:mm); null without one or for no such moment."""
    offset = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:[.]\d{1,9})?)?(?:Z|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(offset), F.try_to_timestamp(text))


def at_time(wall: Column, zone: Column) -> Column:
    """(at, diagnostic): the instant of a wall clock; where the clock was set forward over it there is none, and the diagnostic says so."""
    gap = zone_kind(wall, zone) == "gap"
    return F.struct(F.when(~gap, to_instant(wall, zone)).alias("at"), F.when(gap, "nonexistent-time").alias("diagnostic"))


def inherited_part(hour: Column, part: Column, end_hour: Column, end_part: Column) -> Column:
    """The part of the day of a range's start: its own, else the end's if read so it still is before the end."""
    borrowed = fold_hour(hour, end_part)
    return F.coalesce(part, F.when(borrowed < fold_hour(end_hour, end_part), end_part))


def fold_hour(hour: Column, part: Column) -> Column:
    """A twelve-hour reading with its part of the day, over 24 hours; hours past twelve stay."""
    return (
        F.when(hour > 12, hour)
        .when(part == "morning", F.when(hour == 12, 0).otherwise(hour))
        .when(part == "noon", F.when(hour <= 2, hour + 12).otherwise(hour))
        .when(part == "afternoon", F.when(hour < 12, hour + 12).otherwise(hour))
        .when(part == "evening", F.when(hour == 12, 0).otherwise(hour + 12))
        .when(part == "night", F.when(hour == 12, 0).when(hour >= 5, hour + 12).otherwise(hour))
        .when(part == "pm", F.when(hour == 12, hour).otherwise(hour + 12))
        .when(part == "am", F.when(hour == 12, 0).otherwise(hour))
        .otherwise(hour)
    )


def day_part(hour: Column) -> Column:
    """The part of the day that an hour lies in, null between night and morning."""
    out = F.lit(None).cast("string")
    for name, (start, end) in PART_HOURS.items():
        inside = ((hour >= start) & (hour < end)) if start < end else ((hour >= start) | (hour < end))
        out = F.when(inside, name).otherwise(out)
    return out


def monday(day: Column) -> Column:
    return F.date_add(day, -F.weekday(day))


def week_start(day: Column, first: str = "MO") -> Column:
    """The first day of the calendar week: Monday, or Sunday where weeks begin with it (SU)."""
    return monday(day) if first == "MO" else F.date_add(day, -F.pmod(F.weekday(day) + 1, F.lit(7)))


def weekday_near(day: Column, target: Column, modifier: Column, first: str = "MO", bare: str = "next", following: str = "calendar", distance: Column | int = 1) -> Column:
    """The weekday (0 Monday): bare the next including today; this, next, last by calendar weeks.

    Weeks begin with `first` (MO or SU). A bare weekday may be the one of this week (`bare` thisWeek) or the
    nearest; `following` immediate makes "next" the first after today; `distance` counts further weeks.
    """
    if first not in ("MO", "SU") or bare not in ("next", "thisWeek", "nearest") or following not in ("calendar", "immediate"):
        raise ValueError("unknown policy for weekdays")
    ahead = F.pmod(target - F.weekday(day), F.lit(7))
    place = target if first == "MO" else F.pmod(target + 1, F.lit(7))
    extra = (distance - 1) * 7 if isinstance(distance, Column) else F.lit((distance - 1) * 7)
    begin = week_start(day, first)
    alone = {"next": F.date_add(day, ahead), "thisWeek": F.date_add(begin, place), "nearest": F.date_add(day, F.when(ahead > 3, ahead - 7).otherwise(ahead))}[bare]
    after = F.date_add(begin, place + 7 + extra) if following == "calendar" else F.date_add(day, F.when(ahead == 0, 7).otherwise(ahead) + extra)
    return F.when(modifier.isNull(), alone).when(modifier == "next", after).when(modifier == "last", F.date_add(begin, place - 7 - extra)).otherwise(F.date_add(begin, place))


def week_of_month(month_start: Column, number: Column) -> tuple[Column, Column]:
    """Start and exclusive end of a month's nth seven days (1 to 5), clipped to the month; nulls where it has none."""
    start = F.when(number.between(1, 5), F.date_add(month_start, (number - 1) * 7))
    start = F.when(F.trunc(start, "month") == month_start, start)
    return start, F.least(F.date_add(start, 7), F.add_months(month_start, 1))


def quarter(day: Column, number: Column) -> tuple[Column, Column]:
    """Start and exclusive end of a quarter (1 to 4) of a day's year."""
    start = F.when(number.between(1, 4), F.add_months(F.trunc(day, "year"), (number - 1) * 3))
    return start, F.add_months(start, 3)


def rolled(at: Column, reference: Column, days: int, tries: int = 8) -> Column:
    """A moment moved on by whole steps of days until it isn't before the reference; null where it takes more tries."""
    behind = F.unix_timestamp(reference.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    steps = F.greatest(F.ceil(behind / (86_400 * days)), F.lit(0)).cast("int")
    return F.when(steps < tries, F.timestamp_add("DAY", steps * days, at))


def ordinal_weekday(month_start: Column, target: Column, nth: Column) -> Column:
    """The nth weekday of a month, from the end where nth is negative; null where there is none."""
    first = F.date_add(month_start, F.pmod(target - F.weekday(month_start), F.lit(7)))
    last_day = F.last_day(month_start)
    last = F.date_add(last_day, -F.pmod(F.weekday(last_day) - target, F.lit(7)))
    found = F.when(nth > 0, F.date_add(first, (nth - 1) * 7)).otherwise(F.date_add(last, (nth + 1) * 7))
    return F.when(F.trunc(found, "month") == month_start, found)


def period(day: Column, unit: str, steps: int) -> tuple[Column, Column]:
    """Start and exclusive end of the week, month or year so many steps away."""
    start = F.date_trunc(unit, day.cast("timestamp_ntz"))
    move = lambda n: F.timestamp_add(unit.upper(), F.lit(n), start).cast("date")
    return move(steps), move(steps + 1)


def leap_year_from(year: Column) -> Column:
    """The first leap year not before a year."""
    fourth = F.ceil(year / 4) * 4
    return F.when((fourth % 100 == 0) & (fourth % 400 != 0), fourth + 4).otherwise(fourth).cast("int")


def month_day_next(day: Column, month: int, dom: int) -> Column:
    """The next day of that month on or after a day; a 29 February waits for its year."""
    leap = (month, dom) == (2, 29)
    make = lambda year: F.make_date(leap_year_from(year) if leap else year, F.lit(month), F.lit(dom))
    this = make(F.year(day))
    return F.when(this >= day, this).otherwise(make(F.year(day) + 1))
