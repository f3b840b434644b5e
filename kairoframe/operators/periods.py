"""Periods that overlap made into disjoint ones, and days asked against them.

`coalesced` sweeps the periods of a key in order, bucket by bucket of their beginnings, and carries from bucket to
bucket only how far they reached. `index` keeps a number a key and month whose bits are the days taken, so that
`outside` meets one row for each day that it asks, however many periods there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"_k_{n}"])
    return out


def coalesced(periods: DataFrame, by: list[str], start: str = "from_day", end: str = "to_day", width: int = 64) -> DataFrame:
    """(by, start, end): the disjoint periods [start, end) of days that a key's periods cover; those that touch are one.

    Periods without a beginning, an end or a day in them cover nothing. Keys may be null and are then one key. A task
    orders the beginnings of one key in `width` days, at most one a day; without keys one task orders the
    buckets, as many as the calendar has.
    """
    p = periods.where(F.col(start) < F.col(end)).groupBy(*by, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    p = p.withColumn("_b", F.floor(F.datediff("_s", F.lit("1970-01-01")) / width))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    mine = Window.partitionBy(*by, "_b").orderBy("_s")
    reach = p.groupBy(*by, "_b").agg(F.max("_e").alias("_reach")).withColumn("_reach", F.max("_reach").over(before))
    reach = reach.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_b"]], "_reach")
    rows = p.join(reach, matching(p, reach, [*by, "_b"])).select(*by, "_b", "_s", "_e", "_reach")
    so_far = F.greatest("_reach", F.max("_e").over(mine.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_head", F.when(so_far.isNull() | (F.col("_s") > so_far), F.col("_s")))
    heads = rows.groupBy(*by, "_b").agg(F.max("_head").alias("_carried")).withColumn("_carried", F.max("_carried").over(before))
    heads = heads.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_b"]], "_carried")
    rows = rows.join(heads, matching(rows, heads, [*by, "_b"])).select(*by, "_b", "_s", "_e", "_head", "_carried")
    head = F.coalesce(F.max("_head").over(mine.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried"))
    return rows.withColumn("_head", head).groupBy(*by, "_head").agg(F.max("_e").alias(end)).select(*by, F.col("_head").alias(start), end)


def index(periods: DataFrame, by: list[str], start: str = "from_day", end: str = "to_day") -> DataFrame:
    """(by, month, taken): a row for each key and month with a day taken; bit n of `taken` is the month's day n + 1.

    Periods are made disjoint before they are dealt to months, so there are at most as many rows as the calendar and
    the disjoint periods give, not one for each period and month.
    """
    apart = coalesced(periods, by, start, end)
    last = F.date_sub(end, 1)
    rows = apart.select(*by, start, last.alias("_last"), F.explode(F.sequence(F.trunc(start, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))).alias("month"))
    low = F.greatest(F.datediff(start, "month"), F.lit(0))
    high = F.least(F.datediff("_last", "month"), F.lit(30)) + 1
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    return rows.withColumn("_bits", power(high) - power(low)).groupBy(*by, "month").agg(F.bit_or("_bits").alias("taken"))


def outside(rows: DataFrame, periods: DataFrame, by: list[str], day: str = "day", start: str = "from_day", end: str = "to_day") -> DataFrame:
    """The rows whose day lies in no period of their key; a row without a day stays. Repeated rows stay repeated."""
    taken = index(periods, by, start, end).select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("month").alias("_month"), F.col("taken").alias("_taken"))
    met = rows.join(taken, matching(rows, taken, by) & (F.trunc(rows[day], "month") == taken["_month"]), "left")
    bit = F.call_function("shiftright", F.col("_taken"), F.dayofmonth(rows[day]) - 1).bitwiseAND(F.lit(1))
    return met.where(F.coalesce(bit, F.lit(0)) == 0).select(*[rows[c] for c in rows.columns])
