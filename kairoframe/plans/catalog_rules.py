"""Queries over rules and clauses that differ from row to row, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairoframe.operators import rules

from .catalog import query, spread, table

RULE_DAYS = 800
SHOWN = 12


def family_rule(c: Column, family: Column) -> Column:
    """A rule by family, its numbers from `c`."""
    n, w = (F.pmod(c, F.lit(5)) + 1).cast("int"), F.pmod(c, F.lit(7)).cast("int")
    code = lambda i: F.get(F.array(*[F.lit(d) for d in rules.DAYS]), i)
    work = F.array(*[F.lit(d) for d in rules.DAYS[:5]])
    part = lambda m: F.pmod(c, F.lit(m)).cast("int") + 1
    made = [
        dict(freq="daily", interval=n), dict(freq="weekly", interval=n, by_day=F.array(code(w), code(F.pmod(w + 2, F.lit(7))))), dict(freq="monthly", interval=n, by_month_day=F.array(part(31), F.lit(-1))),
        dict(freq="monthly", by_day=F.array(code(w)), by_set_pos=F.array(-part(4))), dict(freq="yearly", by_month=F.array(part(12)), by_month_day=F.array(part(28))), dict(freq="weekly", by_day=F.array(code(w)), count=n * 3),
        dict(freq="monthly", by_day=work, by_set_pos=F.array(F.lit(1))), dict(freq="daily"),
    ]
    some = [rules.struct_of(rules.RULE, **({"interval": F.lit(1)} | fields | {"freq": F.lit(fields["freq"])})) for fields in made]
    return F.get(F.array(*some), family)


@query(
    "WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS d0, o_orderkey % 8 AS f, o_custkey % 5 + 1 AS n, o_custkey % 7 AS w, o_custkey AS c FROM orders), "
    f"b AS (SELECT r.*, (d0 + i::INT)::DATE AS d FROM r, range(0, {RULE_DAYS}) t(i)), "
    "m AS (SELECT *, f = 5 AND d >= d0 + 20 AND d < d0 + 60 AS gone, min(d) OVER (PARTITION BY o_orderkey) AS a FROM b WHERE CASE f WHEN 0 THEN true WHEN 1 THEN isodow(d) - 1 IN (w, (w + 2) % 7) WHEN 2 THEN day(d) = c % 31 + 1 OR d = last_day(d) "
    "WHEN 3 THEN isodow(d) - 1 = w AND (day(last_day(d)) - day(d)) // 7 = c % 4 WHEN 4 THEN month(d) = c % 12 + 1 AND day(d) = c % 28 + 1 WHEN 5 THEN isodow(d) - 1 = w "
    "WHEN 6 THEN isodow(d) <= 5 AND (day(d) = 1 OR (isodow(d) = 1 AND day(d) <= 3)) ELSE isodow(d) <= 5 END), "
    "i AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderkey ORDER BY d) AS s FROM m WHERE CASE f WHEN 0 THEN (d - a) % n WHEN 1 THEN ((d - (isodow(d) - 1)::INT) - (a - (isodow(a) - 1)::INT)) // 7 % n "
    "WHEN 2 THEN ((year(d) - year(a)) * 12 + month(d) - month(a)) % n ELSE 0 END = 0), "
    "k AS (SELECT *, max(CASE WHEN NOT gone AND NOT (f = 5 AND s > n * 3) THEN s END) OVER (PARTITION BY o_orderkey) AS many FROM i WHERE NOT (f = 5 AND s > n * 3)), "
    "g AS (SELECT *, count(*) FILTER (gone AND s < n * 3) OVER (PARTITION BY o_orderkey) AS taken FROM k) "
    f"SELECT o_orderkey, s::INT AS seq, d AS day, many > {SHOWN} AS truncated, taken::INT AS taken FROM g WHERE NOT gone AND s <= {SHOWN}"
)
def recur_columns(spark, sf_dir):
    """A rule of its own for each order from its date on: the first days, whether there are more, how many an exclusion took."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    orders = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), family_rule(F.col("o_custkey"), F.pmod("o_orderkey", F.lit(8)).cast("int")).alias("rule"))
    family = F.pmod("o_orderkey", F.lit(8))
    weekend = F.when(family == 7, F.array(F.lit(5), F.lit(6)))
    pause = F.when(family == 5, F.array(F.struct(F.date_add("d", 20).alias("start"), F.date_add("d", 60).alias("end"))))
    left = rules.struct_of(rules.EXCLUDED, weekdays=weekend, periods=pause)
    out = rules.expand_df(orders, "rule", F.col("d"), F.date_add("d", RULE_DAYS), SHOWN, excluded=left)
    shown = rules.occurrences(out.withColumn("taken", F.size("left_out")), ["o_orderkey", "truncated", "taken"])
    return shown.select("o_orderkey", "seq", F.col("moment").cast("date").alias("day"), "truncated", "taken")
