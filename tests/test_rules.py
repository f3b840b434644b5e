"""Rules as columns against loops over days."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kairoframe.operators import rules
from kairoframe.plans import catalog_rules

DAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
BEGIN = datetime(2026, 9, 17, 9, 0)  # a Thursday
END = datetime(2029, 1, 1)
RULES = [
    dict(freq="daily", interval=3), dict(freq="daily", interval=2, by_day=["MO", "SA"]), dict(freq="weekly", interval=2, by_day=["WE", "MO"]), dict(freq="weekly", interval=1), dict(freq="weekly", interval=1, times_per=3),
    dict(freq="monthly", interval=1, by_month_day=[31]), dict(freq="monthly", interval=2, by_month_day=[-1, 15]), dict(freq="monthly", interval=1, by_day=["FR"], by_set_pos=[-1]), dict(freq="monthly", interval=1, by_set_pos=[2, -2]),
    dict(freq="monthly", interval=1, by_day=["MO", "TU", "WE", "TH", "FR"], by_set_pos=[1]), dict(freq="monthly", interval=1), dict(freq="monthly", interval=1, by_day=["FR"], by_month_day=[13]),
    dict(freq="yearly", interval=1, by_month=[2], by_month_day=[29]), dict(freq="yearly", interval=1, by_day=["SU"], by_set_pos=[-1]), dict(freq="yearly", interval=1, by_month=[3, 11]), dict(freq="monthly", interval=3, by_month_day=[1], count=4),
    dict(freq="weekly", interval=1, by_day=["SU", "MO"], by_month=[10]), dict(freq="yearly", interval=2),
]


def slow(rule, seconds, until=END):
    """The rule's clocks by a walk over all days; intervals count from the first."""
    on = rule.get("by_day") or ([DAYS[i * 7 // rule["times_per"]] for i in range(rule["times_per"])] if rule.get("times_per") else None)

    def last(d):
        return (date(d.year + d.month // 12, d.month % 12 + 1, 1) - timedelta(1)).day

    def plain(d):
        return (not on or DAYS[d.weekday()] in on) and (not rule.get("by_month_day") or any(d.day == (n if n > 0 else last(d) + n + 1) for n in rule["by_month_day"]))

    def fits(d, anchor, interval):
        months = (d.year - anchor.year) * 12 + d.month - anchor.month
        apart = {"daily": (d - anchor).days, "weekly": ((d - timedelta(d.weekday())) - (anchor - timedelta(anchor.weekday()))).days // 7, "monthly": months, "yearly": d.year - anchor.year}[rule["freq"]]
        if apart % interval or (rule.get("by_month") and d.month not in rule["by_month"]) or not plain(d):
            return False
        if rule.get("by_set_pos"):
            wide = rule["freq"] == "yearly"
            first = date(d.year, 1 if wide else d.month, 1)
            pool = [e for e in (first + timedelta(i) for i in range(366 if wide else 31)) if e.year == d.year and (wide or e.month == d.month) and plain(e)]
            return any(pool[p - 1 if p > 0 else p] == d for p in rule["by_set_pos"] if abs(p) <= len(pool))
        if on or rule.get("by_month_day") or rule["freq"] == "daily":
            return True
        if rule["freq"] == "weekly":
            return d.weekday() == anchor.weekday()
        return d.day == anchor.day and (rule["freq"] == "monthly" or bool(rule.get("by_month")) or d.month == anchor.month)

    at = lambda d: datetime(d.year, d.month, d.day) + timedelta(seconds=seconds or 0)
    since = BEGIN if seconds is not None else datetime(2026, 9, 17)
    walk = [BEGIN.date() + timedelta(i) for i in range(366 * 8)]
    anchor = next((d for d in walk if fits(d, BEGIN.date(), 1) and at(d) >= since), None)
    if anchor is None:
        return []
    return [at(d) for d in walk if d >= anchor and at(d) < until and fits(d, anchor, rule["interval"])][: rule.get("count")]


def rows(spark, some, **others):
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    made = F.array(*[rules.struct_of(rules.RULE, **{k: lit(v) for k, v in r.items()}) for r in some])
    return rules.expand_df(spark.range(1).select(F.posexplode(made).alias("i", "rule")), "rule", F.lit(BEGIN), F.lit(END), **others)


@pytest.mark.parametrize("seconds", [None, 8 * 3600, 20 * 3600])
def test_a_column_of_rules_gives_what_walking_the_days_gives(spark, seconds):
    out = rows(spark, RULES, limit=2000, seconds=None if seconds is None else F.lit(seconds)).select("i", "moments", "truncated").collect()
    assert {r.i: r.moments for r in out} == {i: slow(r, seconds) for i, r in enumerate(RULES)}
    assert not any(r.truncated for r in out)


def test_limits_exclusions_and_what_they_take(spark):
    left = rules.struct_of(rules.EXCLUDED, weekdays=F.array(F.lit(6)), periods=F.expr("array(struct(date'2026-10-01' as start, date'2026-10-04' as end))"), nth=F.expr("array(struct(0 as weekday, -1 as ordinal))"))
    some = [dict(freq="daily", interval=1), dict(freq="daily", interval=1, count=20)]
    short, counted = rows(spark, some, limit=15, excluded=left).orderBy("i").collect()
    gone = {date(2026, 9, 28), date(2026, 10, 1), date(2026, 10, 2), date(2026, 10, 3)}
    walk = [date(2026, 9, 17) + timedelta(i) for i in range(60)]
    kept = [d for d in walk if d.weekday() != 6 and d not in gone | {date(2026, 10, 26)}]
    assert [t.date() for t in short.moments] == kept[:15] and short.truncated and {t.date() for t in short.left_out} == gone
    assert [t.date() for t in counted.moments] == kept[:15] and counted.truncated and {t.date() for t in counted.left_out} == gone


def test_hours_gaps_and_wrong_rules(spark):
    some = [dict(freq="hourly", interval=5), dict(freq="daily", interval=1, times_per=3)]
    hourly, spread = rows(spark, some, limit=4).orderBy("i").collect()
    assert hourly.moments == [BEGIN + timedelta(hours=5 * i) for i in range(4)]
    assert spread.moments == [datetime(2026, 9, 17, 16), datetime(2026, 9, 18, 0), datetime(2026, 9, 18, 8), datetime(2026, 9, 18, 16)]
    berlin = rows(spark, [dict(freq="yearly", interval=1, by_month=[3], by_day=["SU"], by_set_pos=[-1], count=3)], seconds=F.lit(9000), zone=F.lit("Europe/Berlin")).head()
    assert berlin.moments == [] and berlin.wrong == "no-occurrence"  # half past two, the night the clocks go forward
    bad = [dict(freq="daily", interval=0), dict(freq="weekly", interval=1, times_per=8), dict(freq="centennial", interval=1), dict(freq="monthly", interval=1, by_month_day=[30], by_month=[2])]
    assert [r.wrong for r in rows(spark, bad).orderBy("i").collect()] == ["invalid-quantity", "invalid-frequency", "unsupported", "no-occurrence"]
    assert rows(spark, [dict(freq="daily", interval=1, count=2)], until=F.lit(END)).head().wrong == "invalid-bound"
    nothing = rules.expand_df(spark.range(1).select(F.lit(None).cast(rules.RULE).alias("rule")), "rule", F.lit(BEGIN), F.lit(END)).head()
    assert (nothing.first, nothing.moments, nothing.wrong) == (None, None, None)
    assert rows(spark, some).where("false").count() == 0


def test_exclusions_that_empty_the_first_spans_tried(spark):
    """Nearly all of the first hundred days is left out, so the limit and the count are met far behind the first spans."""
    gone = F.expr("array(struct(date'2026-09-19' as start, date'2027-01-01' as end), struct(date'2027-01-03' as start, date'2027-06-01' as end))")
    some = [dict(freq="daily", interval=1), dict(freq="daily", interval=1, count=6), dict(freq="hourly", interval=24), dict(freq="weekly", interval=1, by_day=["TH"], by_month=[9], count=9)]
    days, counted, hours, rare = rows(spark, some, limit=5, excluded=rules.struct_of(rules.EXCLUDED, periods=gone)).orderBy("i").collect()
    kept = [date(2026, 9, 17), date(2026, 9, 18), date(2027, 1, 1), date(2027, 1, 2), date(2027, 6, 1), date(2027, 6, 2)]
    assert [t.date() for t in days.moments] == [t.date() for t in hours.moments] == [t.date() for t in counted.moments] == kept[:5]
    assert days.truncated and counted.truncated and len(days.left_out) == len(counted.left_out) == 104 + 149
    assert [t.date() for t in rare.moments] == [date(2026, 9, 17), date(2027, 9, 2), date(2027, 9, 9), date(2027, 9, 16), date(2027, 9, 23)] and rare.truncated
    late = rows(spark, some[:2], limit=3, cutoff=F.lit(datetime(2028, 12, 28))).orderBy("i").collect()
    assert [[t.date() for t in r.moments] for r in late] == [[date(2028, 12, 28), date(2028, 12, 29), date(2028, 12, 30)], []]


def test_one_small_file_is_not_one_task(spark, tmp_path):
    spark.sql("select id o_orderkey, id * 7 o_custkey, timestamp_ntz'2026-01-01 00:00:00' o_orderdate from range(400)").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert catalog_rules.recur_columns(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1
