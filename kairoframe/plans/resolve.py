"""Compiled clauses to their occurrences: dates by `schedule`, rules by `rules`, and what times, shifts and durations make of them.

Each clause becomes an array of occurrences inside its own row; the only join is with the named days, a broadcast of
some 700 keys whatever the texts. Clauses that are null give no occurrence and no code. A clause that can't be resolved
has a code and no occurrences: invalid-date (no such day, or a named one out of range), invalid-range (an end that isn't
after its start), invalid-bound (both a duration and an end), nonexistent-time (its clock was skipped in the zone),
unsupported-exception (a rule that leaves out holidays or lunar days), or the rule's own code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.functions import civil
from kairoframe.functions.text import let
from kairoframe.operators import dates, rules, schedule

from .phrases import shifted

ADDED = ["clause", "occurrences", "truncated", "code"]
OCCURRENCES = "array<struct<start:timestamp_ntz,end:timestamp_ntz,open:string,all_day:boolean>>"


def spec_of(d: Column, reference: Column) -> Column:
    """A compiled date as a specification of `schedule`."""
    days = rules.weekday_numbers(d["days"])
    moved = F.when(d["modifier"] == "next", 1).when(d["modifier"] == "last", -1)
    of_cycle = dates.cycle_year(d["cycle"], F.year(reference))
    named = F.when(d["kind"].isin("holiday", "lunar"), F.coalesce(d["year"], of_cycle, F.year(reference) + moved)).otherwise(F.coalesce(d["year"], d["from"]["year"]))
    same = {n: d[n] for n in ("kind", "offset", "modifier", "distance", "group", "week", "edge", "unit", "ordinal")}
    made = schedule.spec(
        **same, days=days, weekday=F.get(days, F.lit(0)), year=named, month=F.coalesce(d["month"], d["from"]["month"]), day=F.coalesce(d["day"], d["from"]["day"]),
        to_year=d["to"]["year"], to_month=d["to"]["month"], to_day=d["to"]["day"],
    )
    return F.when(d.isNotNull(), made)


def day_key(d: Column) -> Column:
    """The key of a holiday or lunar date among the named days."""
    lunar = F.concat(F.lit("L:"), F.coalesce(d["month"].cast("string"), F.lit("*")), F.lit("-"), d["day"].cast("string"), F.when(d["leap"], "-leap").otherwise(""))
    return F.when(d["kind"] == "holiday", d["name"]).when(d["kind"] == "lunar", lunar)


def clock_seconds(clock: Column, end: bool = False) -> Column:
    """Seconds into the day of a clock, a named time or the edge of a part of the day."""
    part = F.lit(None).cast("int")
    for name, hours in civil.PART_HOURS.items():
        part = F.when(clock["part"] == name, hours[end] * 3600).otherwise(part)
    plain = clock["hour"] * 3600 + F.coalesce(clock["minute"], F.lit(0)) * 60 + F.coalesce(clock["second"], F.lit(0))
    return F.coalesce(F.when(clock["named"] == "noon", 43_200).when(clock["named"] == "midnight", 0), part, plain)


def moved(at: Column, quantity: Column, sign: Column | int, zone: Column | None) -> Column:
    """A wall clock moved by a quantity and its smaller parts; null quantities leave it."""
    rest = F.coalesce(quantity["components"], F.expr("cast(array() as array<struct<amount:double,unit:string>>)"))
    parts = F.concat(F.array(F.struct(quantity["amount"].alias("amount"), quantity["unit"].alias("unit"))), rest)
    parts = F.when(quantity["amount"].isNull(), F.slice(parts, 1, 0)).otherwise(parts)
    return F.aggregate(parts, at, lambda a, q: shifted(a, q["amount"] * sign, q["unit"], zone))


def is_pattern(e: Column) -> Column:
    """Is what a rule leaves out a bare weekday or day group?"""
    return e["kind"].isin("weekday", "dayGroup") & e["modifier"].isNull()


def dated_exceptions(rule: Column) -> Column:
    """What a rule leaves out that has to be resolved to periods first."""
    return F.filter(rule["except"], lambda e: ~is_pattern(e) & ~e["kind"].isin("ordinalWeekday", "holiday", "lunar"))


def exclusions(rule: Column, found: Column) -> Column:
    """What a rule leaves out: bare weekdays and day groups, nth weekdays, and the periods found for other dates."""
    group = lambda e: F.when(e["group"] == "weekend", F.array(F.lit(5), F.lit(6))).when(e["group"] == "weekday", F.array(*[F.lit(i) for i in range(5)]))
    weekdays = F.flatten(F.transform(F.filter(rule["except"], is_pattern), lambda e: F.coalesce(group(e), rules.weekday_numbers(e["days"]))))
    nth = F.transform(F.filter(rule["except"], lambda e: e["kind"] == "ordinalWeekday"), lambda e: F.struct(F.get(rules.weekday_numbers(e["days"]), F.lit(0)).alias("weekday"), e["ordinal"].alias("ordinal")))
    periods = F.transform(F.flatten(found), lambda p: F.struct(p["start"].cast("date").alias("start"), p["end"].cast("date").alias("end")))
    return rules.struct_of(rules.EXCLUDED, weekdays=weekdays, periods=periods, nth=nth)


def resolve_df(df: DataFrame, reference: str, limit: int = 30, zone: Column | None = None, week_start: str = "MO") -> DataFrame:
    """One row a clause: df's columns but `clauses`, with clause (from 0), occurrences, truncated and code.

    `reference` is a column of wall clocks; occurrences are wall clocks, at most `limit` a clause, their ends exclusive.
    A bare clock is the next such one, a bare weekday's clock that has passed is the next week's; rules run for twelve
    months. Rows without clauses stay, with nulls. Input columns with the names of the new ones are an error.
    """
    if clash := {*ADDED, "rule"} & set(df.columns):
        raise ValueError(f"columns of these names exist: {sorted(clash)}")
    keep = [c for c in df.columns if c != "clauses"]
    ref = F.col(reference).cast("timestamp_ntz")
    rows = df.select(*keep, F.posexplode_outer("clauses").alias("clause", "_c")).withColumn("_ref", ref)
    c, ref = F.col("_c"), F.col("_ref")
    rows = rows.withColumn("_key", day_key(c["date"])).withColumn("rule", c["recurrence"])
    named = dates.named_days(df.sparkSession)
    rows = rows.join(F.broadcast(named.withColumnRenamed("day_key", "_key").withColumnRenamed("days", "_days")), "_key", "left")
    r, t, d = F.col("rule"), c["time"], c["date"]
    one_day = lambda p: F.coalesce(p["end"], F.timestamp_add("DAY", F.lit(1), p["start"]))
    settled = F.monotonically_increasing_id() >= 0  # always true; what is made under it isn't made again wherever it is read
    own_dates = F.array(d, r["start"], r["until"])
    asked = F.concat(own_dates, F.coalesce(dated_exceptions(r), F.slice(own_dates, 1, 0)))
    days = lambda i: F.when(i == 0, F.col("_days"))
    # all dates of a clause go through one expression, which is by far the largest of the plan
    rows = rows.withColumn("_found", F.when(settled & c.isNotNull(), F.transform(asked, lambda e, i: let(spec_of(e, ref), lambda s: schedule.resolve_dates(s, ref, days(i), week_start)))))
    first = lambda i: F.get(F.get("_found", F.lit(i)), F.lit(0))
    rows = rows.withColumn("_from", F.when(r["start"].isNotNull(), first(1))).withColumn("_to", F.when(r["until"].isNotNull(), first(2)))
    rows = rows.withColumn("_s", clock_seconds(t["start"])).withColumn("_e", F.when(t["end"].isNotNull(), clock_seconds(t["end"], True)).when(c["duration"].isNull() & ~F.coalesce(t["open"] == "end", F.lit(False)) & t["start"]["part"].isNotNull(), clock_seconds(t["start"], True)))
    midnight = F.date_trunc("day", ref).cast("timestamp_ntz")
    ranged = F.coalesce(r["start"]["kind"] == "calendarRange", F.lit(False))
    begin = F.when(F.col("_from").isNotNull(), F.when(ranged, F.greatest(F.col("_from")["start"], midnight)).otherwise(F.col("_from")["start"])).otherwise(ref)
    span = F.when(r["span"].isNotNull(), moved(F.date_trunc("day", begin).cast("timestamp_ntz"), r["span"], 1, None))
    until = F.least(F.coalesce(F.when(ranged, F.col("_from")["end"]), F.when(F.col("_to").isNotNull(), one_day(F.col("_to")))), span)
    rows = rows.withColumn("_left", F.when(settled, exclusions(r, F.slice("_found", 4, F.greatest(F.size("_found") - 3, F.lit(0)))))).withColumn("_begin", begin).withColumn("_last", until)
    rows = rules.expand_df(
        rows, "rule", F.col("_begin"), F.timestamp_add("MONTH", F.lit(12), ref), limit, F.col("_s"), F.col("_left"), F.col("_last"),
        F.when(F.col("_s").isNull(), midnight).otherwise(ref), zone, week_start,
    )
    rows = rows.withColumn("_periods", F.when(c.isNotNull() & r.isNull(), F.get("_found", F.lit(0))))
    at = lambda day, seconds: F.timestamp_add("SECOND", seconds, F.date_trunc("day", day).cast("timestamp_ntz"))
    of_day = lambda day: F.hour(day) * 3600 + F.minute(day) * 60 + F.second(day).cast("int")
    sign = F.when(c["shift"]["direction"] == "before", -1).otherwise(1)
    shift = lambda when: moved(when, c["shift"], sign, zone)
    own_clock = t.isNull() & F.coalesce((d.isNull() & (c["shift"].isNotNull() | c["duration"].isNotNull())) | (d["kind"] == "now"), F.lit(False))
    unit_clock = F.coalesce((d["kind"] == "relativeUnit") & d["unit"].isin(schedule.CLOCK_UNITS), F.lit(False))
    qualified = F.coalesce((d["kind"] == "relativeUnit") & d["edge"].isNull() & t.isNotNull() & t["start"]["part"].isNull(), F.lit(False))
    unit_moved = shifted(ref, F.when(d["modifier"] == "this", 0).when(d["modifier"] == "last", -1).otherwise(1).cast("double"), d["unit"], None)
    step = F.when(t.isNull(), 0).when(F.coalesce(d["kind"].isin("weekday", "dayGroup") & d["modifier"].isNull(), F.lit(False)), 7).when(d.isNull() & c["shift"].isNull(), 1).otherwise(0)
    sought = F.when((t["open"] == "start") & F.col("_e").isNotNull(), F.col("_e")).otherwise(F.col("_s"))
    rows = rows.withColumn("_step", step).withColumn("_own", own_clock).withColumn("_qualified", qualified).withColumn("_sought", sought)
    step = F.col("_step")

    def rolled(day: Column) -> Column:
        behind = F.unix_seconds(ref.cast("timestamp")) - F.unix_seconds(at(day, F.col("_sought")).cast("timestamp"))
        days = F.ceil(F.greatest(behind, F.lit(0)) / (86_400 * step)).cast("int") * step
        return F.when(step > 0, F.timestamp_add("DAY", days, day)).otherwise(day)

    def ended(day: Column, own: Column) -> Column:
        """The end that a clause's clock gives, else the period's own."""
        late = F.timestamp_add("DAY", F.when(F.col("_e") < F.col("_s"), 1).otherwise(0), day)
        by_clock = F.coalesce(F.when(c["end_date"].isNotNull(), F.get(let(spec_of(c["end_date"], ref), lambda s: schedule.resolve_dates(s, day, week_start=week_start)), F.lit(0))["start"]), late)
        return F.when(F.col("_e").isNotNull() & ~F.col("_own"), at(by_clock, F.col("_e"))).when(~F.col("_qualified") & ~F.coalesce(t["open"] == "end", F.lit(False)), own)

    nothing = F.lit(None).cast("timestamp_ntz")
    day_of = lambda p: F.struct(let(F.when(F.col("_qualified"), unit_moved).otherwise(p["start"]), rolled).alias("day"), p["end"].alias("end"))
    of_rule = lambda m: F.struct(m.alias("day"), nothing.alias("end"))
    begun = lambda day: F.when(r.isNotNull(), day).otherwise(shift(F.when(F.col("_own"), ref).when(F.col("_s").isNotNull(), at(day, F.col("_s"))).otherwise(day)))
    over = lambda p: let(ended(p["day"], p["end"]), lambda e: F.when(r.isNotNull(), e).otherwise(shift(e)))
    rows = rows.withColumn("_base", F.when(settled & r.isNotNull(), F.transform("moments", of_rule)).otherwise(F.transform("_periods", day_of)))
    rows = rows.withColumn("_raw", F.when(settled, F.transform("_base", lambda p: F.struct(begun(p["day"]).alias("start"), over(p).alias("end")))))
    lasting = lambda o: F.struct(o["start"].alias("start"), F.when(c["duration"].isNotNull(), moved(o["start"], c["duration"], 1, zone)).otherwise(o["end"]).alias("end"), t["open"].alias("open"), (t.isNull() & ~F.col("_own") & ~unit_clock & (of_day(o["start"]) == 0)).alias("all_day"))
    rows = rows.withColumn("_out", F.array_sort(F.transform("_raw", lasting)).cast(OCCURRENCES))
    gap = F.lit(False) if zone is None else F.exists("_raw", lambda o: ~F.col("_own") & (civil.zone_kind(o["start"], zone) == "gap"))
    out_of_reach = F.exists(r["except"], lambda e: e["kind"].isin("holiday", "lunar"))
    code = (
        F.when(F.coalesce(out_of_reach, F.lit(False)), "unsupported-exception").when(r.isNotNull(), F.col("wrong")).when(F.coalesce(d["lunar"], F.lit(False)), "unsupported").when(F.size("_periods") == 0, "invalid-date")
    )
    code = F.coalesce(code, F.when(c["duration"].isNotNull() & F.exists("_raw", lambda o: o["end"].isNotNull()), "invalid-bound").when(gap, "nonexistent-time").when(F.exists("_out", lambda o: F.coalesce(o["end"] <= o["start"], F.lit(False))), "invalid-range"))
    rows = rows.withColumn("code", F.when(c.isNotNull(), code))
    many = F.when(r.isNotNull(), F.col("truncated")).otherwise(F.size("_out") > limit)
    return rows.select(*keep, "clause", F.when(F.col("code").isNull(), F.slice("_out", 1, limit)).alias("occurrences"), F.when(c.isNotNull(), F.coalesce(many, F.lit(False))).alias("truncated"), "code")
