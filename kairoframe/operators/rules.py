"""Recurrence rules as columns: each row has a rule of its own, and one expansion serves all of them.

A rule is a struct of `RULE`'s fields (missing ones null). Its periods (every interval-th day, week, month or
year from the first occurrence) are counted by arithmetic and only their own days are made, so a row costs what
its rule gives and not the days between; nothing is shuffled. Where a rule begins is found first, with an
interval of one, in a short span and only then in eight years.

A null rule gives nulls. A rule that gives nothing within eight years has no `first` and the code no-occurrence;
one whose fields contradict each other has its code in `wrong` and no moments. Days that a month lacks are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairoframe.functions import civil
from kairoframe.functions.text import let

from .recurrence import DAYS, times_per_week

RULE = "struct<freq:string,interval:int,by_day:array<string>,by_month_day:array<int>,by_set_pos:array<int>,by_month:array<int>,times_per:int,count:int>"
#: Weekdays that are always left out, periods of days (end exclusive), and the nth weekdays of each month.
EXCLUDED = "struct<weekdays:array<int>,periods:array<struct<start:date,end:date>>,nth:array<struct<weekday:int,ordinal:int>>>"
SEED_DAYS = (8, 70, 366 * 8)
#: Hours that a period has at most, and the periods for each moment wanted that are tried before the whole preview.
PERIOD_HOURS = {"hourly": 1, "daily": 24, "weekly": 7 * 24, "monthly": 31 * 24, "yearly": 366 * 24}
TRIED = (1, 3)
MOMENTS = "array<timestamp_ntz>"


def struct_of(kind: str, **fields: Column) -> Column:
    """A struct of such a type from the fields that are given, the others null."""
    names = [f.name for f in T._parse_datatype_string(kind).fields]
    if unknown := set(fields) - set(names):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(kind)


def given(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def steps(distance: Column, interval: Column) -> Column:
    """0, interval, twice it and so on, as far as the distance."""
    return F.when(distance >= 0, F.transform(F.sequence(F.lit(0), F.floor(distance / interval).cast("int")), lambda i: i * interval)).otherwise(F.expr("cast(array() as array<int>)"))


def weekday_numbers(days: Column) -> Column:
    names = F.array(*[F.lit(d) for d in DAYS])
    return F.array_sort(F.array_distinct(F.transform(days, lambda d: (F.array_position(names, d) - 1).cast("int"))))


def month_dates(first: Column, rule: Column, on: Column, day: Column) -> Column:
    """A month's dates by its rule, ascending, before any position is chosen; `day` counts where the rule names none."""
    last = F.last_day(first)
    inside = lambda ds: F.filter(ds, lambda d: (d >= first) & (d <= last))
    by_number = inside(F.transform(rule["by_month_day"], lambda n: F.when(n > 0, F.date_add(first, n - 1)).when(n < 0, F.date_add(last, n + 1))))
    weeks = F.array(*[F.lit(7 * k) for k in range(5)])
    by_weekday = inside(F.flatten(F.transform(on, lambda w: F.transform(weeks, lambda k: F.date_add(first, F.pmod(w - F.weekday(first), F.lit(7)) + k)))))
    both = F.when(given(on), F.filter(by_number, lambda d: F.array_contains(on, F.weekday(d)))).otherwise(by_number)
    whole = F.when(given(rule["by_set_pos"]), F.sequence(first, last)).otherwise(inside(F.array(F.date_add(first, day - 1))))
    return F.array_sort(F.array_distinct(F.when(given(rule["by_month_day"]), both).when(given(on), by_weekday).otherwise(whole)))


def at_positions(dates: Column, rule: Column) -> Column:
    """The dates at the rule's positions (negative: from the end), or all where it has none."""
    some = F.transform(F.filter(rule["by_set_pos"], lambda p: p != 0), lambda p: F.try_element_at(dates, p))
    return F.when(given(rule["by_set_pos"]), F.array_sort(F.array_distinct(F.array_compact(some)))).otherwise(dates)


def days_of(rule: Column, on: Column, interval: Column, anchor: Column, end: Column, week_start: str) -> Column:
    """The days of a daily, weekly, monthly or yearly rule from the anchor's period to the end's."""
    allowed = lambda d: (
        (~given(on) | F.array_contains(on, F.weekday(d))) & (~given(rule["by_month"]) | F.array_contains(rule["by_month"], F.month(d)))
        & (~given(rule["by_month_day"]) | F.exists(rule["by_month_day"], lambda n: F.dayofmonth(d) == F.when(n > 0, n).otherwise(F.dayofmonth(F.last_day(d)) + n + 1)))
    )
    daily = F.filter(F.transform(steps(F.datediff(end, anchor), interval), lambda i: F.date_add(anchor, i)), allowed)
    week = civil.week_start(anchor, week_start)
    place = lambda w: F.pmod(w - (0 if week_start == "MO" else 6), F.lit(7))
    offsets = F.array_sort(F.transform(F.when(given(on), on).otherwise(F.array(F.weekday(anchor))), place))
    weekly = F.flatten(F.transform(steps(F.datediff(end, week), interval * 7), lambda i: F.transform(offsets, lambda o: F.date_add(week, i + o))))
    month = F.trunc(anchor, "month")
    between = (F.year(end) - F.year(anchor)) * 12 + F.month(end) - F.month(anchor)
    own = lambda i: at_positions(month_dates(F.add_months(month, i), rule, on, F.dayofmonth(anchor)), rule)
    monthly = F.filter(F.flatten(F.transform(steps(between, interval), own)), lambda d: ~given(rule["by_month"]) | F.array_contains(rule["by_month"], F.month(d)))
    wide = given(rule["by_month_day"]) | given(on) | given(rule["by_set_pos"])
    named = F.when(given(rule["by_month"]), F.array_sort(rule["by_month"])).when(wide, F.sequence(F.lit(1), F.lit(12))).otherwise(F.array(F.month(anchor)))
    year = F.trunc(anchor, "year")
    of_year = lambda i: at_positions(F.flatten(F.transform(named, lambda m: month_dates(F.add_months(year, i * 12 + m - 1), rule, on, F.dayofmonth(anchor)))), rule)
    yearly = F.flatten(F.transform(steps(F.year(end) - F.year(anchor), interval), of_year))
    out = F.when(rule["freq"] == "daily", daily).when(rule["freq"] == "weekly", F.filter(weekly, allowed)).when(rule["freq"] == "monthly", monthly)
    return out.when(rule["freq"] == "yearly", yearly)


def hours_of(times: Column) -> Column:
    """The hours that so many times a day are spread over."""
    return F.transform(F.sequence(F.lit(0), times - 1), lambda i: F.floor(i * 24 / times).cast("int"))


def weekdays_of(rule: Column, week_start: str = "MO") -> Column:
    """The numbers of a rule's weekdays, those that so many times a week are spread over included."""
    spread = F.element_at(F.array(*[F.array(*[F.lit(d) for d in sorted(times_per_week(n, week_start))]) for n in range(1, 8)]), rule["times_per"])
    return F.when((rule["freq"] == "weekly") & ~given(rule["by_day"]) & rule["times_per"].between(1, 7), spread).otherwise(weekday_numbers(rule["by_day"]))


def moments(rule: Column, on: Column, interval: Column, anchor: Column, end: Column, seconds: Column, week_start: str = "MO") -> Column:
    """The wall clocks of a rule from the anchor on and before the end, ascending, exclusions not yet taken.

    `on` has its weekdays' numbers (`weekdays_of`), `seconds` is the clock of its day. An hourly rule counts from the anchor's own clock.
    """
    fits = lambda t: (~given(on) | F.array_contains(on, F.weekday(t))) & (~given(rule["by_month"]) | F.array_contains(rule["by_month"], F.month(t)))
    length = F.floor((F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(anchor.cast("timestamp"))) / 3600).cast("int")
    hourly = F.filter(F.transform(steps(length, interval), lambda i: F.timestamp_add("HOUR", i, anchor)), fits)
    of_day = F.when((rule["freq"] == "daily") & rule["times_per"].between(1, 24), F.transform(hours_of(rule["times_per"]), lambda h: h * 3600)).otherwise(F.array(seconds))
    by_day = let(days_of(rule, on, interval, anchor.cast("date"), end.cast("date"), week_start), lambda ds: F.flatten(F.transform(ds, lambda d: F.transform(of_day, lambda s: F.timestamp_add("SECOND", s, d.cast("timestamp_ntz"))))))
    return F.filter(F.when(rule["freq"] == "hourly", hourly).otherwise(by_day), lambda t: (t >= anchor) & (t < end))


def by_pattern(t: Column, excluded: Column) -> Column:
    """Is a moment's weekday one that is always left out?"""
    return F.coalesce(F.array_contains(excluded["weekdays"], F.weekday(t)), F.lit(False))


def is_excluded(t: Column, excluded: Column) -> Column:
    """Does a moment fall on a weekday, in a period or on an nth weekday that is left out?"""
    d = t.cast("date")
    place = F.floor((F.dayofmonth(d) - 1) / 7) + 1
    back = F.floor((F.dayofmonth(F.last_day(d)) - F.dayofmonth(d)) / 7) + 1
    in_period = F.coalesce(F.exists(excluded["periods"], lambda p: (d >= p["start"]) & (d < F.coalesce(p["end"], F.date_add(p["start"], 1)))), F.lit(False))
    nth = F.coalesce(F.exists(excluded["nth"], lambda n: (F.weekday(d) == n["weekday"]) & (F.when(n["ordinal"] > 0, place).otherwise(-back) == n["ordinal"])), F.lit(False))
    return by_pattern(t, excluded) | in_period | nth


def wrong(rule: Column, bounded: Column, timed: Column) -> Column:
    """The code of what contradicts itself in a rule, null where nothing does."""
    times = rule["times_per"]
    many = F.when(rule["freq"] == "weekly", 7).when(rule["freq"] == "daily", 24).otherwise(0)
    return (
        F.when((rule["count"] < 1) | (rule["interval"] < 1), "invalid-quantity").when(rule["count"].isNotNull() & bounded, "invalid-bound").when(times.isNotNull() & ~times.between(1, many), "invalid-frequency")
        .when((rule["freq"] == "daily") & times.isNotNull() & timed, "invalid-time").when(~F.coalesce(rule["freq"], F.lit("")).isin("hourly", "daily", "weekly", "monthly", "yearly"), "unsupported")
    )


def expand_df(
    df: DataFrame, rule: str, begin: Column, horizon: Column, limit: int = 30, seconds: Column | None = None, excluded: Column | None = None, until: Column | None = None,
    cutoff: Column | None = None, zone: Column | None = None, week_start: str = "MO",
) -> DataFrame:
    """df with first, moments (at most `limit`), truncated, left_out and wrong.

    `begin` is the wall clock from which the rule is looked for; `seconds` its clock in the day, null for whole days;
    `until` and `horizon` are exclusive ends of rule and preview; moments before the cutoff count but aren't shown.
    `left_out` has the moments that a period or an nth weekday took before the rule or the preview ended: those
    that weekdays alone took belong to the rule's own pattern. Clocks that don't exist in the zone are passed over.
    """
    r, none = F.col(rule), F.expr(f"cast(array() as {MOMENTS})")
    clock = F.lit(None).cast("int") if seconds is None else seconds.cast("int")
    left = F.lit(None).cast(EXCLUDED) if excluded is None else excluded
    last = F.lit(None).cast("timestamp_ntz") if until is None else until.cast("timestamp_ntz")
    rows = df.withColumn("_x", F.struct(begin.cast("timestamp_ntz").alias("begin"), clock.alias("clock"), left.alias("left"), last.alias("until"), F.least(horizon.cast("timestamp_ntz"), last).alias("end")))
    x = F.col("_x")
    generated = (r["freq"] == "hourly") | ((r["freq"] == "daily") & r["times_per"].isNotNull())
    rows = rows.withColumn("wrong", F.when(r.isNotNull(), wrong(r, x["until"].isNotNull(), x["clock"].isNotNull())))
    zero = F.coalesce(x["clock"], F.lit(0))
    midnight = F.date_trunc("day", x["begin"]).cast("timestamp_ntz")
    start = F.when(generated, F.when(x["clock"].isNotNull(), F.timestamp_add("SECOND", zero, midnight)).when(r["freq"] == "hourly", x["begin"]).otherwise(midnight)).otherwise(midnight)
    real = (lambda t: F.lit(True)) if zone is None else (lambda t: civil.zone_kind(t, zone) != "gap")
    bare = F.when(generated | x["clock"].isNotNull(), x["begin"]).otherwise(midnight)
    fit = lambda days: F.filter(moments(r, F.col("_on"), F.lit(1), F.col("_start"), F.timestamp_add("DAY", days, F.col("_start")), zero, week_start), lambda t: (t >= F.col("_since")) & ~is_excluded(t, x["left"]) & real(t))
    seed = F.aggregate(F.array(*[F.lit(n) for n in SEED_DAYS]), F.lit(None).cast("timestamp_ntz"), lambda found, days: F.when(found.isNotNull(), found).otherwise(F.get(fit(days), F.lit(0))))
    rows = rows.withColumn("_on", weekdays_of(r, week_start)).withColumn("_start", start).withColumn("_since", bare)
    rows = rows.withColumn("first", F.when(r.isNotNull() & F.col("wrong").isNull(), seed))
    rows = rows.withColumn("wrong", F.when(r.isNotNull() & F.col("wrong").isNull() & F.col("first").isNull(), "no-occurrence").otherwise(F.col("wrong")))
    anchor = F.col("first")
    settled = F.monotonically_increasing_id() >= 0  # always true; a filter above isn't pushed below, where it would repeat the expansion
    since = F.coalesce(F.lit(None).cast("timestamp_ntz") if cutoff is None else cutoff.cast("timestamp_ntz"), F.col("_since"))
    interval = F.coalesce(r["interval"], F.lit(1))
    unkept = lambda ts: F.filter(ts, lambda t: ~is_excluded(t, x["left"]))
    wanted = F.greatest(F.coalesce(r["count"], F.lit(0)), F.lit(limit + 1)).cast("long")
    hours = F.lit(0)
    for freq, n in PERIOD_HOURS.items():
        hours = F.when(r["freq"] == freq, n).otherwise(hours)
    tried = [F.timestamp_add("HOUR", F.least((wanted * k + 1) * interval * hours, F.lit(100 * 366 * 24)).cast("int"), F.greatest(anchor, since)) for k in TRIED]
    ends = F.array(*[F.when(x["end"].isNotNull(), F.least(t, x["end"])) for t in tried], x["end"])
    # a shorter preview will do where it has all of the count, or without one more than are shown: what comes later changes nothing
    enough = lambda ts: F.coalesce(F.when(r["count"].isNotNull(), F.size(unkept(ts)) >= r["count"]).otherwise(F.size(F.filter(unkept(ts), lambda t: t >= since)) > limit), F.lit(False))
    made = lambda end: F.filter(moments(r, F.col("_on"), interval, anchor, end, zero, week_start), real)
    further = lambda a, end: F.when(a["done"], a).otherwise(let(made(end), lambda ts: F.struct(ts.alias("ts"), (enough(ts) | F.coalesce(end >= x["end"], F.lit(False))).alias("done"))))
    none_yet = F.struct(F.lit(None).cast(MOMENTS).alias("ts"), F.lit(False).alias("done"))
    rows = rows.withColumn("_all", F.when(settled & anchor.isNotNull(), F.aggregate(ends, none_yet, further)["ts"]))
    kept = unkept(F.col("_all"))
    rows = rows.withColumn("_kept", F.when(r["count"].isNotNull(), F.slice(kept, 1, F.greatest(r["count"], F.lit(0)))).otherwise(kept))
    rows = rows.withColumn("_shown", F.filter("_kept", lambda t: t >= since))
    rows = rows.withColumn("truncated", F.size("_shown") > limit).withColumn("moments", F.when(r.isNotNull(), F.coalesce(F.slice("_shown", 1, limit), none)))
    ended = F.when(F.size("_kept") == r["count"], F.element_at("_kept", -1)).when(F.col("truncated"), F.get("_shown", F.lit(limit)))
    taken = F.filter("_all", lambda t: is_excluded(t, x["left"]) & ~by_pattern(t, x["left"]) & (ended.isNull() | (t < ended)))
    return rows.withColumn("left_out", F.when(r.isNotNull(), F.coalesce(taken, none))).drop("_x", "_on", "_start", "_since", "_all", "_kept", "_shown")


def occurrences(expanded: DataFrame, keep: list[str]) -> DataFrame:
    """One row a moment of `expand_df`'s rows: the columns kept, seq from 1 and moment; rows without a moment give none."""
    rows = expanded.select(*keep, F.posexplode_outer("moments").alias("seq", "moment")).where("moment is not null")
    return rows.withColumn("seq", F.col("seq") + 1)
