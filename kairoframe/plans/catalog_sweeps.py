"""Queries over zones of each row, periods that overlap and spans of texts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoframe.functions import text
from kairoframe.operators import alignment, periods, zones

from .catalog import SQL_KIND, SQL_TOKENS, query, table

#: Zones by number: shifts of an hour, half an hour and none, a name that there isn't, no zone.
ZONES = ["America/New_York", "Australia/Lord_Howe", "Asia/Ho_Chi_Minh", "Europe/Berlin", "Asia/Kathmandu", "No/Where", None]
MINUTES = [105, 135, 165]
#: Places of text whose tokens and spans one task sweeps, about.
TASK_PLACES = 1 << 21
SQL_ZONES = ", ".join("NULL" if z is None else f"'{z}'" for z in ZONES)


@query(
    f"WITH l AS (SELECT o_orderkey, [{SQL_ZONES}][o_custkey % {len(ZONES)} + 1] AS zone, date_trunc('day', o_orderdate) + INTERVAL 1 MINUTE * k AS wall FROM orders, (VALUES {', '.join(f'({m})' for m in MINUTES)}) v(k)), "
    "z AS (SELECT *, CASE WHEN zone IS NULL OR zone = 'No/Where' THEN 'UTC' ELSE zone END AS real FROM l), a AS (SELECT *, timezone(real, wall) AS ins FROM z), "
    "t AS (SELECT *, list_sort(list_filter([ins - INTERVAL 1 HOUR, ins - INTERVAL 30 MINUTE, ins, ins + INTERVAL 30 MINUTE, ins + INTERVAL 1 HOUR], lambda x: timezone(real, x) = wall)) AS ins_all FROM a) "
    "SELECT o_orderkey, wall, zone, CASE WHEN zone IS NULL THEN NULL WHEN zone = 'No/Where' THEN 'unknown-zone' WHEN len(ins_all) = 0 THEN 'gap' WHEN len(ins_all) = 1 THEN 'exact' ELSE 'overlap' END AS kind, "
    "CASE WHEN zone <> 'No/Where' THEN epoch(ins_all[1])::BIGINT END AS \"at\", CASE WHEN zone <> 'No/Where' THEN epoch(ins_all[2])::BIGINT END AS later FROM t"
)
def zoned_walls(spark, sf_dir):
    """Three times in the night of each order, in a zone of the order's own: instants, gaps and both instants of overlaps."""
    wall = F.timestamp_add("MINUTE", F.col("k"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp_ntz")))
    zone = F.get(F.array(*[F.lit(z) for z in ZONES]), F.pmod("o_custkey", F.lit(len(ZONES))).cast("int"))
    orders = table(spark, sf_dir, "orders").withColumn("k", F.explode(F.array(*[F.lit(m) for m in MINUTES])))
    rows = orders.select("o_orderkey", zone.alias("zone"), wall.cast("timestamp_ntz").alias("wall"))
    out = zones.resolve_walls(rows, "wall", "zone")
    return out.withColumns({c: F.unix_seconds(c) for c in ("at", "later")})


SQL_BUSY = "p AS (SELECT l_suppkey, l_shipdate::DATE AS s, l_shipdate::DATE + (l_quantity::INT % 8 - 1) AS e FROM lineitem)"


def busy(spark, sf_dir):
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("from_day"), F.date_add(day, F.pmod(F.col("l_quantity").cast("int"), F.lit(8)) - 1).alias("to_day"))


@query(
    f"WITH {SQL_BUSY}, m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT l_suppkey, s, e FROM p WHERE s < e)), "  # equal periods have no order of their own
    "i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m) "
    "SELECT l_suppkey, min(s) AS from_day, max(e) AS to_day FROM i GROUP BY l_suppkey, n"
)
def busy_periods(spark, sf_dir):
    """Each supplier's days with something under way, as disjoint periods."""
    return periods.coalesced(busy(spark, sf_dir), ["l_suppkey"])


@query(f"WITH {SQL_BUSY}, o AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate::DATE + (l_orderkey % 40)::INT AS day FROM lineitem) SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l_suppkey = o.l_suppkey AND o.day >= p.s AND o.day < p.e)")
def idle_days(spark, sf_dir):
    """Days some time after each line's shipment on which its supplier has nothing under way."""
    day = F.date_add(F.col("l_shipdate").cast("date"), F.pmod("l_orderkey", F.lit(40)).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", day.alias("day"))
    return periods.outside(rows, busy(spark, sf_dir), ["l_suppkey"])


@query(
    f"WITH p AS (SELECT conv_id, turn, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT conv_id, turn, {SQL_TOKENS} AS ts FROM conversations)), "
    "o AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p), "
    f"w AS (SELECT *, a + length(t) AS z FROM o WHERE {SQL_KIND} <> 3), s AS (SELECT conv_id, turn, unnest(range(0, length(text), 50)) AS b FROM conversations), "
    "c AS (SELECT conv_id, turn, b, count(*) FILTER (a >= b AND z <= b + 40) AS tokens, coalesce(bool_or(a < b AND z > b), false) AS cut_start, coalesce(bool_or(a < b + 40 AND z > b + 40), false) AS cut_end FROM s LEFT JOIN w USING (conv_id, turn) GROUP BY ALL) "
    'SELECT conv_id, turn, b AS start, b + 40 AS "end", tokens, cut_start, cut_end, tokens > 0 AND NOT cut_start AND NOT cut_end AS aligned FROM c'
)
def span_alignment(spark, sf_dir):
    """Spans of forty places in each turn against its words: how many each holds, which of its ends cut one.

    A first pass only adds up the lengths of the texts, so that a task's share stays the same however many there are.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", text.tokens(F.col("text")).alias("ts"))
    parts = rows.select("conv_id", "turn", F.inline(F.arrays_zip(F.col("ts").alias("t"), text.starts(F.col("ts")).alias("start"))))
    tokens = parts.where(text.kind(F.col("t")) != 3).select("conv_id", "turn", "start", (F.col("start") + text.units(F.col("t"))).alias("end"))
    last = text.units(F.col("text")) - 1
    spans = rows.where(last >= 0).select("conv_id", "turn", F.explode(F.sequence(F.lit(0), last, F.lit(50))).alias("start")).withColumn("end", F.col("start") + 40)
    by = ["conv_id", "turn"]
    places = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), places // TASK_PLACES + 1)
    return alignment.spans_held(alignment.swept(tokens, spans, by, partitions=tasks), by)
