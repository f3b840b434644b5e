"""The queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoframe.functions import civil, features, lexicon, lunar, numerals, text
from kairoframe.operators import dates, evaluation, islands, recurrence

from .parse import parse_df
from .phrases import occurrences_df

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to as many tasks as a shuffle has: for those that cost far more than reading them, as a small file is one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def once(df: DataFrame, keys: list[str], work, few: bool = False) -> DataFrame:
    """df with what `work` makes of its keys: each distinct combination of them is worked on once and joined back, nulls included.

    `work` takes a table of the keys and gives it back with columns more; rows that it leaves out are left out.
    `few` says that there can only be few combinations, so that the rows needn't be shuffled.
    """
    found = work(spread(df.select(*keys).distinct(), *keys))
    more = [c for c in found.columns if c not in keys]
    found = found.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *more)
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(found[f"_of_{k}"])
    return df.join(F.broadcast(found) if few else found, same).select(*df.columns, *more)


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


SQL_TOKENS = r"regexp_extract_all(text, '[\p{L}_]+(?:[''’][\p{L}]+)*|[0-9]+|\s+|[^\s]')"
SQL_KIND = r"CASE WHEN regexp_matches(t, '^\s') THEN 3 WHEN regexp_matches(t, '^[0-9]') THEN 1 WHEN regexp_matches(t, '^[\p{L}_]') THEN 0 ELSE 2 END"


@query(f"SELECT {SQL_KIND} AS kind, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT unnest({SQL_TOKENS}) AS t FROM documents) GROUP BY 1")
def tokenize_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("t"))
    return rows.groupBy(text.kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


@query("SELECT item_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295)::BIGINT AS fnv FROM benchmark")
def token_fnv(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.fnv(F.col("text")).alias("fnv"))


@query(f"WITH p AS (SELECT conv_id, turn, ts, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT conv_id, turn, {SQL_TOKENS} AS ts FROM conversations)) SELECT conv_id, turn, pos::BIGINT AS pos, t, coalesce(sum(length(t)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p")
def token_offsets(spark, sf_dir):
    return turn_offsets(table(spark, sf_dir, "conversations"))


def turn_offsets(turns: DataFrame) -> DataFrame:
    rows = turns.withColumn("ts", text.tokens(F.col("text")))
    rows = rows.select("conv_id", "turn", F.posexplode(F.arrays_zip(F.col("ts").alias("t"), text.starts(F.col("ts")).alias("start"))).alias("pos", "x"))
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("x.t").alias("t"), F.col("x.start").cast("long").alias("start"))


@query(f"WITH p AS (SELECT conv_id, turn, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT conv_id, turn, {SQL_TOKENS} AS ts FROM conversations)) SELECT conv_id, turn, pos::BIGINT AS pos, t, coalesce(sum(length(t)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p")
def token_offsets_all(spark, sf_dir):
    return turn_offsets(table(spark, sf_dir, "conversations"))


@query(f"SELECT CASE WHEN l<=1 THEN 0 WHEN l<=2 THEN 1 WHEN l<=3 THEN 2 WHEN l<=4 THEN 3 WHEN l<=6 THEN 4 WHEN l<=8 THEN 5 WHEN l<=12 THEN 6 ELSE 7 END AS bucket, count(*) AS n FROM (SELECT length(unnest({SQL_TOKENS})) AS l FROM documents) GROUP BY 1")
def length_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("t"))
    return rows.groupBy(text.length_bucket(F.col("t")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, k AS keep_start, least(k + 96, n) AS keep_end, greatest(k - 16, 0) AS see_start, least(k + 112, n) AS see_end FROM (SELECT doc_id, n, unnest(range(0, n, 96)) AS k FROM (SELECT doc_id, len({SQL_TOKENS}) AS n FROM documents))")
def hopping_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"))
    return rows.select("doc_id", F.inline(islands.hopping(F.col("n")))).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("keep_start", "keep_end", "see_start", "see_end")])


TIME_WORDS = sorted({*lexicon.RELATIVE_DAYS, *lexicon.DAY_PARTS, *lexicon.UNITS, *lexicon.WEEKDAYS})


@query("SELECT role, count(*) AS n, sum(CASE WHEN regexp_matches(lower(text), '[0-9]|(^|[^\\p{L}0-9])(" + "|".join(TIME_WORDS) + ")([^\\p{L}0-9]|$)') THEN 1 ELSE 0 END)::BIGINT AS timed FROM conversations GROUP BY role")
def mentions_time(spark, sf_dir):
    said = text.key(F.col("text")).rlike(r"[0-9]|(^|[^\p{L}0-9])(" + "|".join(TIME_WORDS) + r")([^\p{L}0-9]|$)")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(said.cast("long")).alias("timed"))


SPOKEN = [("hai mươi mốt", 21), ("mười lăm", 15), ("một trăm hai mươi", 120), ("hai nghìn không trăm hai mươi sáu", 2026), ("ba rưỡi", 3.5), ("năm mươi tư", 54), ("nửa", 0.5), ("trăm rưỡi", 100.5), ("12", 12), ("mươi", None), ("hai ba", None), ("một nghìn lẻ", None)]


@query("SELECT t, v::DOUBLE AS v FROM (VALUES " + ", ".join(f"('{t}', {'NULL' if v is None else v})" for t, v in SPOKEN) + ") s(t, v)")
def spelled_numbers(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in SPOKEN], "t string").select("t", numerals.spelled_number(F.col("t")).alias("v"))


@query("WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a) SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n FROM b GROUP BY ALL")
def role_segments(spark, sf_dir):
    rows = islands.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", F.date_trunc("day", "ts"))
    return rows.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS s, event_id FROM events), b AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 10800 THEN 0 ELSE 1 END AS n FROM a WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id) AS session FROM b) SELECT user_id, session::BIGINT AS session, count(*) AS n, max(s) - min(s) AS seconds FROM c GROUP BY ALL")
def expression_islands(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    rows = islands.sessions(rows, ["user_id"], F.col("s"), 10_800, "event_id")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("seconds"))


@query("SELECT h::INT AS h, p, CASE WHEN h > 12 THEN h WHEN p = 'morning' THEN CASE WHEN h = 12 THEN 0 ELSE h END WHEN p = 'noon' THEN CASE WHEN h <= 2 THEN h + 12 ELSE h END WHEN p = 'afternoon' THEN CASE WHEN h < 12 THEN h + 12 ELSE h END WHEN p = 'evening' THEN CASE WHEN h = 12 THEN 0 ELSE h + 12 END WHEN p = 'night' THEN CASE WHEN h = 12 THEN 0 WHEN h >= 5 THEN h + 12 ELSE h END ELSE h END::INT AS f FROM range(0, 25) r(h), (VALUES ('morning'), ('noon'), ('afternoon'), ('evening'), ('night')) q(p)")
def meridiem_fold(spark, sf_dir):
    parts = F.array(*[F.lit(p) for p in civil.PART_HOURS])
    rows = spark.range(25).select(F.col("id").cast("int").alias("h"), F.explode(parts).alias("p"))
    return rows.withColumn("f", civil.fold_hour(F.col("h"), F.col("p")).cast("int"))


@query("WITH l AS (SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 90 MINUTE * k AS wall FROM orders, (VALUES (1), (2)) v(k)), a AS (SELECT *, timezone('America/New_York', wall) AS ins FROM l) SELECT o_orderkey, wall, CASE WHEN timezone('America/New_York', ins) <> wall THEN 'gap' WHEN timezone('America/New_York', ins + INTERVAL 1 HOUR) = wall OR timezone('America/New_York', ins - INTERVAL 1 HOUR) = wall THEN 'overlap' ELSE 'exact' END AS kind FROM a")
def zone_classify(spark, sf_dir):
    return wall_kinds(table(spark, sf_dir, "orders"), [90, 180])


def wall_kinds(orders: DataFrame, minutes: list[int]) -> DataFrame:
    wall = F.timestamp_add("MINUTE", F.col("k"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp_ntz")))
    rows = orders.select("o_orderkey", "o_orderdate", F.explode(F.array(*[F.lit(m) for m in minutes])).alias("k")).select("o_orderkey", wall.cast("timestamp_ntz").alias("wall"))
    return rows.withColumn("kind", civil.zone_kind(F.col("wall").cast("timestamp"), F.lit("America/New_York")))


@query("WITH l AS (SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 1 MINUTE * k AS wall FROM orders, (VALUES (90), (150), (180)) v(k)), a AS (SELECT *, timezone('America/New_York', wall) AS ins FROM l) SELECT o_orderkey, wall, CASE WHEN timezone('America/New_York', ins) <> wall THEN 'gap' WHEN timezone('America/New_York', ins + INTERVAL 1 HOUR) = wall OR timezone('America/New_York', ins - INTERVAL 1 HOUR) = wall THEN 'overlap' ELSE 'exact' END AS kind FROM a")
def zone_classify_all(spark, sf_dir):
    return wall_kinds(table(spark, sf_dir, "orders"), [90, 150, 180])


@query("SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S') || '+07:00' AS saigon, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS berlin, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc FROM events")
def iso_render(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    zones = {"saigon": "Asia/Ho_Chi_Minh", "berlin": "Europe/Berlin", "utc": "UTC"}
    return table(spark, sf_dir, "events").select("event_id", *[civil.iso(at, F.lit(z)).alias(n) for n, z in zones.items()])


@query("SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS month_later, (o_orderdate::DATE - INTERVAL 1 YEAR)::DATE AS year_before, (o_orderdate::DATE + INTERVAL 10 DAY)::DATE AS days_later FROM orders")
def calendar_shifts(spark, sf_dir):
    d = F.col("d").cast("timestamp_ntz")
    move = lambda unit, n: F.timestamp_add(unit, F.lit(n), d).cast("date")
    return order_days(spark, sf_dir).select("o_orderkey", move("MONTH", 1).alias("month_later"), move("YEAR", -1).alias("year_before"), move("DAY", 10).alias("days_later"))


@query("SELECT CASE WHEN h >= 6 AND h < 11 THEN 'morning' WHEN h >= 11 AND h < 13 THEN 'noon' WHEN h >= 13 AND h < 18 THEN 'afternoon' WHEN h >= 18 AND h < 22 THEN 'evening' WHEN h >= 22 OR h < 5 THEN 'night' END AS part, count(*) AS n FROM (SELECT hour(ts) AS h FROM events) GROUP BY 1")
def day_part_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(civil.day_part(F.hour("ts")).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, julian(o_orderdate::DATE)::BIGINT AS jdn FROM orders")
def julian_day(spark, sf_dir):
    return order_days(spark, sf_dir).select("o_orderkey", lunar.julian_day(F.col("d")).cast("long").alias("jdn"))


TET = ["2020-01-25", "2021-02-12", "2022-02-01", "2023-01-22", "2024-02-10", "2025-01-29", "2026-02-17", "2027-02-06", "2028-01-26", "2029-02-13", "2030-02-02", "2031-01-23", "2032-02-11", "2033-01-31", "2034-02-19", "2035-02-08"]


@query("SELECT year(d) AS year, d AS tet FROM (VALUES " + ", ".join(f"(DATE '{d}')" for d in TET) + ") t(d)")
def tet_dates(spark, sf_dir):
    months = lunar.lunar_months(spark, 2020, 2035).where("month = 1 and not leap")
    return months.select(F.col("year").cast("long").alias("year"), F.date_from_unix_date(F.col("start_jdn") - 2440588).alias("tet"))


def _sql_moon() -> str:
    """The lunar month table in SQL, from the same series."""
    terms = " + ".join(f"({c}) * sin(radians({a} * m + {b} * p + {d} * f))" for c, a, b, d in lunar.MOON_TERMS)
    return f"""WITH k AS (SELECT k::DOUBLE AS k, k / 1236.85 AS t FROM range(1100, 1300) r(k)),
a AS (SELECT *, 359.2242 + 29.10535608*k - 0.0000333*t*t - 0.00000347*t*t*t AS m, 306.0253 + 385.81691806*k + 0.0107306*t*t + 0.00001236*t*t*t AS p, 21.2964 + 390.67050646*k - 0.0016528*t*t - 0.00000239*t*t*t AS f FROM k),
b AS (SELECT k, floor(2415020.75933 + 29.53058868*k + 0.0001178*t*t - 0.000000155*t*t*t + 0.00033*sin(radians(166.56 + 132.87*t - 0.009173*t*t)) + (0.1734 - 0.000393*t)*sin(radians(m)) + {terms} - (-0.000278 + 0.000265*t + 0.000262*t*t) + 0.5 + 7/24.0)::INT AS jd FROM a),
c AS (SELECT *, (jd - 0.5 - 7/24.0 - 2451545)/36525 AS t FROM b),
d AS (SELECT k, jd, 280.46645 + 36000.76983*t + 0.0003032*t*t + (1.9146 - 0.004817*t - 0.000014*t*t)*sin(radians(g)) + (0.019993 - 0.000101*t)*sin(radians(2*g)) + 0.00029*sin(radians(3*g)) AS lon FROM (SELECT *, 357.5291 + 35999.0503*t - 0.0001559*t*t - 0.00000048*t*t*t AS g FROM c)),
e AS (SELECT k, jd, floor((lon - 360*floor(lon/360))/30) AS s FROM d),
f AS (SELECT *, lead(jd) OVER (ORDER BY k) - jd AS len, lead(s) OVER (ORDER BY k) AS n FROM e),
g AS (SELECT *, sum(CASE WHEN s <= 8 AND n >= 9 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS c FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY c) AS z FROM g),
l AS (SELECT *, sum(CASE WHEN s = n AND z = 13 AND i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY k) AS q FROM h),
months AS (SELECT jd, len, (i - least(q, 1) + 10) % 12 + 1 AS month, s = n AND z = 13 AND i > 0 AND q = 1 AS leap, DATE '1970-01-01' + (jd - 2440588)::INT AS start FROM l WHERE c > 0 AND len IS NOT NULL),
lunar AS (SELECT *, CASE WHEN month >= 11 AND month(start) <= 2 THEN year(start) - 1 ELSE year(start) END AS year FROM months)
"""


@query(_sql_moon() + "SELECT o_orderkey, year AS lunar_year, month::BIGINT AS lunar_month, (o_orderdate::DATE - start + 1)::BIGINT AS lunar_day, leap AS lunar_leap FROM orders JOIN lunar ON o_orderdate::DATE - start >= 0 AND o_orderdate::DATE - start < len")
def solar_to_lunar(spark, sf_dir):
    rows = lunar.to_lunar(order_days(spark, sf_dir), "d", lunar.lunar_months(spark, 1993, 2003))
    return rows.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in ("lunar_year", "lunar_month", "lunar_day")], "lunar_leap")


@query(_sql_moon() + "SELECT year, month::BIGINT AS month, leap, len::BIGINT AS length FROM lunar WHERE year BETWEEN 1993 AND 2003")
def lunar_month_length(spark, sf_dir):
    months = lunar.lunar_months(spark, 1993, 2003)
    return months.select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "leap", F.col("length").cast("long").alias("length"))


@query("SELECT y, (y - 4) % 60 AS cycle, list_extract(['giáp','ất','bính','đinh','mậu','kỷ','canh','tân','nhâm','quý'], ((y - 4) % 10 + 1)::INT) || ' ' || list_extract(['tý','sửu','dần','mão','thìn','tỵ','ngọ','mùi','thân','dậu','tuất','hợi'], ((y - 4) % 12 + 1)::INT) AS name FROM range(1900, 2101) r(y)")
def sexagenary_year(spark, sf_dir):
    rows = spark.range(1900, 2101).select(F.col("id").alias("y"), lunar.cycle(F.col("id")).cast("long").alias("cycle"))
    return rows.withColumn("name", lexicon.sexagenary_name(F.col("cycle").cast("int")))


@query("WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders) SELECT o_orderkey, w::INT AS w, d + ((w - (isodow(d) - 1) + 7) % 7)::INT AS bare, (date_trunc('week', d)::DATE + w::INT) AS this, (date_trunc('week', d)::DATE + w::INT + 7) AS next, (date_trunc('week', d)::DATE + w::INT - 7) AS last FROM o, range(0, 7) r(w)")
def weekday_modifier(spark, sf_dir):
    rows = order_days(spark, sf_dir).select("o_orderkey", "d", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("w"))
    at = lambda m: civil.weekday_near(F.col("d"), F.col("w"), F.lit(m).cast("string"))
    return rows.select("o_orderkey", "w", at(None).alias("bare"), at("this").alias("this"), at("next").alias("next"), at("last").alias("last"))


@query("WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders) SELECT o_orderkey, " + ", ".join(f"(date_trunc('{u}', d) + INTERVAL '{n} {u}')::DATE AS {u}_{name}, (date_trunc('{u}', d) + INTERVAL '{n + 1} {u}')::DATE AS {u}_{name}_end" for u in ("week", "month", "year") for name, n in (("last", -1), ("this", 0), ("next", 1))) + " FROM o")
def relative_periods(spark, sf_dir):
    out = []
    for unit in ("week", "month", "year"):
        for name, n in (("last", -1), ("this", 0), ("next", 1)):
            start, end = civil.period(F.col("d"), unit, n)
            out += [start.alias(f"{unit}_{name}"), end.alias(f"{unit}_{name}_end")]
    return order_days(spark, sf_dir).select("o_orderkey", *out)


@query("WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders) SELECT o_orderkey, CASE WHEN make_date(year(d), 3, 15) >= d THEN make_date(year(d), 3, 15) ELSE make_date(year(d) + 1, 3, 15) END AS march, CASE WHEN make_date(year(d), 9, 2) >= d THEN make_date(year(d), 9, 2) ELSE make_date(year(d) + 1, 9, 2) END AS national_day, (SELECT min(x) FROM (SELECT try_cast(y || '-02-29' AS DATE) AS x FROM range(1990, 2020) r(y)) WHERE x >= d) AS leap_day FROM o")
def calendar_rollforward(spark, sf_dir):
    d = F.col("d")
    return order_days(spark, sf_dir).select("o_orderkey", civil.month_day_next(d, 3, 15).alias("march"), civil.month_day_next(d, 9, 2).alias("national_day"), civil.month_day_next(d, 2, 29).alias("leap_day"))


@query("WITH o AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m FROM orders), x AS (SELECT o_orderkey, m, unnest(range(0, day(last_day(m)))) AS i FROM o), y AS (SELECT o_orderkey, m + i::INT AS d FROM x), f AS (SELECT o_orderkey, d, row_number() OVER (PARTITION BY o_orderkey ORDER BY d) AS a, row_number() OVER (PARTITION BY o_orderkey ORDER BY d DESC) AS z FROM y WHERE isodow(d) = 5) SELECT o_orderkey, max(CASE WHEN a = 2 THEN d END) AS second_friday, max(CASE WHEN z = 1 THEN d END) AS last_friday, max(CASE WHEN a = 5 THEN d END) AS fifth_friday FROM f GROUP BY o_orderkey")
def ordinal_weekday(spark, sf_dir):
    m = F.trunc("d", "month")
    at = lambda n: civil.ordinal_weekday(m, F.lit(4), F.lit(n))
    return order_days(spark, sf_dir).select("o_orderkey", at(2).alias("second_friday"), at(-1).alias("last_friday"), at(5).alias("fifth_friday"))


FIRST_DAYS = "WITH c AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1), days AS (SELECT k, d AS a, d + i::INT AS d FROM c, range(0, 366) r(i)) "


def first_days(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").cast("date").alias("d"))


def expanded(rows: DataFrame, dates, limit: int, count: int | None = None) -> DataFrame:
    out = recurrence.occurrences(rows, "k", dates, limit, count)
    return out.select("k", F.col("seq").cast("long").alias("seq"), "day", "truncated")


def top_sql(where: str, limit: int) -> str:
    return FIRST_DAYS + f"SELECT k, seq, d AS day, n > {limit} AS truncated FROM (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) AS seq, count(*) OVER (PARTITION BY k) AS n FROM days WHERE {where}) WHERE seq <= {limit}"


def year_end():
    return F.date_add("d", 365)



@query(top_sql("isodow(d) IN (1, 4) AND (date_diff('day', date_trunc('week', a)::DATE, date_trunc('week', d)::DATE) // 7) % 2 = 0", 10))
def recur_weekly(spark, sf_dir):
    return expanded(first_days(spark, sf_dir), recurrence.weekly(F.col("d"), year_end(), [0, 3], 2), 10)


@query(top_sql("day(d) = 15 OR d = last_day(d)", 12))
def recur_monthly_day(spark, sf_dir):
    return expanded(first_days(spark, sf_dir), recurrence.monthly(F.col("d"), year_end(), [15, -1]), 12)


@query(top_sql("isodow(d) <= 5 AND d = (SELECT max(x) FROM (SELECT last_day(d) - j::INT AS x FROM range(0, 5) q(j)) WHERE isodow(x) <= 5)", 12))
def recur_setpos(spark, sf_dir):
    return expanded(first_days(spark, sf_dir), recurrence.positions(F.col("d"), year_end(), [0, 1, 2, 3, 4], -1), 12)


@query(top_sql("month(d) = 9 AND day(d) = 2", 5))
def recur_yearly(spark, sf_dir):
    return expanded(first_days(spark, sf_dir), recurrence.yearly(F.col("d"), year_end(), 9, 2), 5)


@query(top_sql("isodow(d) IN (1, 3, 5)", 8))
def recur_times_per(spark, sf_dir):
    return expanded(first_days(spark, sf_dir), recurrence.weekly(F.col("d"), year_end(), recurrence.times_per_week(3)), 8)


@query(FIRST_DAYS + "SELECT k, d AS day FROM days WHERE isodow(d) = 1 AND NOT (d >= make_date(year(d), 7, 1) AND d < make_date(year(d), 9, 1))")
def recur_except(spark, sf_dir):
    rows = first_days(spark, sf_dir)
    occ = rows.select("k", F.explode(recurrence.weekly(F.col("d"), year_end(), [0])).alias("day"))
    years = spark.range(1990, 2011).select(F.make_date("id", F.lit(7), F.lit(1)).alias("from_day"), F.make_date("id", F.lit(9), F.lit(1)).alias("to_day"))
    return recurrence.without(occ, years)


@query("WITH c AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1) SELECT k, 'DTSTART;VALUE=DATE:' || strftime(d, '%Y%m%d') || chr(10) || 'RRULE:FREQ=WEEKLY;INTERVAL=1;BYDAY=MO,WE;UNTIL=' || strftime(d + 90, '%Y%m%d') AS weekly, 'DTSTART;VALUE=DATE:' || strftime(d, '%Y%m%d') || chr(10) || 'RRULE:FREQ=MONTHLY;INTERVAL=2;BYMONTHDAY=1,-1;COUNT=5' AS monthly FROM c")
def rrule_text(spark, sf_dir):
    return first_days(spark, sf_dir).select(
        "k", recurrence.rrule(F.col("d"), "WEEKLY", by_day=["MO", "WE"], until=F.date_add("d", 90)).alias("weekly"), recurrence.rrule(F.col("d"), "MONTHLY", 2, by_month_day=[1, -1], count=5).alias("monthly")
    )


@query("SELECT k, day, rank, truncated FROM (SELECT o_custkey AS k, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) > 3 AS truncated FROM orders) WHERE rank <= 3")
def occurrence_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return recurrence.top(rows, "k", ["o_orderdate", "o_orderkey"], 3).select("k", "day", F.col("rank").cast("long").alias("rank"), "truncated")


@query("SELECT CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' WHEN NOT regexp_matches(text, '[.!?]$') THEN 'no sentence' WHEN length(text) < 200 THEN 'short' WHEN length(text) > 4000 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def corpus_filter(spark, sf_dir):
    t = F.col("text")
    reason = F.when(t.rlike("[0-9]"), "digits").when(~t.rlike(r"[.!?]\z"), "no sentence").when(F.length(t) < 200, "short").when(F.length(t) > 4000, "long").otherwise("kept")
    return table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 7 = 0")
def stride_sample(spark, sf_dir):
    return islands.stride(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("WITH b AS (SELECT DISTINCT sha256(lower(trim(unnest(string_split(text, '.'))))) AS h FROM benchmark), s AS (SELECT doc_id, trim(unnest(string_split(text, '.'))) AS s FROM documents) SELECT doc_id, count(*) AS n FROM s WHERE length(s) > 20 AND sha256(lower(s)) NOT IN (SELECT h FROM b) GROUP BY doc_id")
def fingerprint_antijoin(spark, sf_dir):
    cut = lambda t: F.explode(F.split(t, "[.]"))
    held = table(spark, sf_dir, "benchmark").select(cut(F.col("text")).alias("s")).select(F.sha2(F.lower(F.trim("s")), 256).alias("h")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", cut(F.col("text")).alias("s")).select("doc_id", F.trim("s").alias("s")).where(F.length("s") > 20)
    return rows.withColumn("h", F.sha2(F.lower("s"), 256)).join(held, "h", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT item_id, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT item_id, {SQL_TOKENS} AS ts FROM benchmark)), o AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p), s AS (SELECT item_id, b AS span_start, b + 40 AS span_end FROM (SELECT item_id, unnest(range(0, length(text), 100)) AS b FROM benchmark)) SELECT item_id, span_start, count(*) AS n FROM o JOIN s USING (item_id) WHERE start >= span_start AND start + length(t) <= span_end GROUP BY ALL")
def span_token_join(spark, sf_dir):
    units = text.units(F.col("text"))
    return span_counts(table(spark, sf_dir, "benchmark"), F.when(units > 0, units - 1))


def span_counts(items: DataFrame, last: Column) -> DataFrame:
    """Tokens inside spans of 40 units that start at every 100th up to `last` (null: no span)."""
    rows = items.withColumn("ts", text.tokens(F.col("text")))
    tokens = rows.select("item_id", F.inline(F.arrays_zip(F.col("ts").alias("t"), text.starts(F.col("ts")).alias("start")))).withColumn("end", F.col("start") + text.units(F.col("t")))
    spans = rows.select("item_id", F.explode(F.sequence(F.lit(0), last, F.lit(100))).alias("b")).select("item_id", F.col("b").cast("long").alias("span_start"), (F.col("b") + 40).alias("span_end"))
    return islands.within(tokens, spans, "item_id").groupBy("item_id", "span_start").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT item_id, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT item_id, {SQL_TOKENS} AS ts FROM benchmark)), o AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p), s AS (SELECT item_id, b AS span_start, b + 40 AS span_end FROM (SELECT item_id, unnest(range(0, length(text), 100)) AS b FROM benchmark)) SELECT item_id, span_start, count(*) AS n FROM o JOIN s USING (item_id) WHERE start >= span_start AND start + length(t) <= span_end GROUP BY ALL")
def span_token_join_all(spark, sf_dir):
    units = text.units(F.col("text"))
    return span_counts(table(spark, sf_dir, "benchmark"), F.when(units > 0, units - 1))


@query("WITH j AS (SELECT lang, quality = 1 AS t, n_chars > 1000 AS g FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) AS n FROM j GROUP BY lang) SELECT lang, tp, fp, fn, n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c")
def label_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return islands.scores(rows, F.col("quality") == 1, F.col("n_chars") > 1000, [F.col("lang")])


@query("WITH j AS (SELECT quality = 1 AS t, n_chars FROM labels JOIN documents USING (doc_id)), c AS (SELECT x AS threshold, count(*) FILTER (t AND n_chars > x) AS tp, count(*) FILTER (NOT t AND n_chars > x) AS fp, count(*) FILTER (t AND n_chars <= x) AS fn FROM j, range(0, 5001, 500) r(x) GROUP BY x) SELECT threshold, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c")
def threshold_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    found = evaluation.threshold_scores(rows, F.col("quality") == 1, F.col("n_chars"), list(range(0, 5001, 500)), [])
    return found.select(F.col("threshold").cast("long").alias("threshold"), "f1")


@query("WITH j AS (SELECT lang, quality = 1 AS t, n_chars FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, x AS threshold, count(*) FILTER (t AND n_chars > x) AS tp, count(*) FILTER (NOT t AND n_chars > x) AS fp, count(*) FILTER (t AND n_chars <= x) AS fn FROM j, range(0, 5001, 250) r(x) GROUP BY lang, x), m AS (SELECT threshold, min(2 * tp / (2 * tp + fp + fn)) AS least FROM c GROUP BY threshold) SELECT threshold, least FROM m ORDER BY least DESC, threshold LIMIT 1")
def threshold_maximin(spark, sf_dir):
    """The length whose worst score over the languages is best."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    found = evaluation.threshold_scores(rows, F.col("quality") == 1, F.col("n_chars"), list(range(0, 5001, 250)), [F.col("lang")])
    return evaluation.best_threshold(found.withColumn("threshold", F.col("threshold").cast("long")), "threshold", "f1", "lang")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


PHRASES = {
    "hôm nay": ("d", "d + 1", True), "ngày mai": ("d + 1", "d + 2", True), "hôm kia": ("d - 2", "d - 1", True),
    "thứ hai tuần sau": ("date_trunc('week', d)::DATE + 7", "date_trunc('week', d)::DATE + 8", True),
    "thứ ba tuần trước": ("date_trunc('week', d)::DATE - 6", "date_trunc('week', d)::DATE - 5", True),
    "tuần sau": ("date_trunc('week', d)::DATE + 7", "date_trunc('week', d)::DATE + 14", True),
    "tháng này": ("date_trunc('month', d)::DATE", "(date_trunc('month', d) + INTERVAL 1 MONTH)::DATE", True),
    "năm ngoái": ("(date_trunc('year', d) - INTERVAL 1 YEAR)::DATE", "date_trunc('year', d)::DATE", True),
    "3 giờ chiều mai": ("d + 1 + INTERVAL 15 HOUR", "NULL", False), "đêm nay": ("d + INTERVAL 22 HOUR", "d + INTERVAL 29 HOUR", False),
    "8h30 sáng": ("d + 1 + INTERVAL 510 MINUTE", "NULL", False), "hai mươi mốt ngày nữa": ("d + INTERVAL 21 DAY + INTERVAL 9 HOUR", "NULL", False),
    "hai tuần trước": ("d - INTERVAL 14 DAY + INTERVAL 9 HOUR", "NULL", False), "xin chào": ("NULL", "NULL", False),
}


@query("WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) " + " UNION ALL ".join(f"SELECT d, '{p}' AS text, ({a})::TIMESTAMP AS start, ({b})::TIMESTAMP AS \"end\", {w} AS all_day, {'NULL' if a != 'NULL' else chr(39) + 'no-expression' + chr(39)} AS diagnostic FROM o" for p, (a, b, w) in PHRASES.items()))
def parse_phrases(spark, sf_dir):
    days = order_days(spark, sf_dir).select("d").distinct()
    rows = days.select("d", F.explode(F.array(*[F.lit(p) for p in PHRASES])).alias("text")).withColumn("ref", F.timestamp_add("HOUR", F.lit(9), F.col("d").cast("timestamp_ntz")))
    return parse_df(rows, "ref").drop("ref")


def sql_next(month: int, day: int) -> str:
    return f"(CASE WHEN make_date(year(d), {month}, {day}) >= d THEN make_date(year(d), {month}, {day}) ELSE make_date(year(d) + 1, {month}, {day}) END)"


def sql_lunar(month: int, day: int) -> str:
    return f"(SELECT min(l.start + {day - 1}) FROM lunar l WHERE l.month = {month} AND NOT l.leap AND l.start + {day - 1} >= d)"


def sql_weekday(number: int) -> str:
    return f"(d + (({number} - isodow(d) + 8) % 7)::INT)"


MONDAY, SATURDAY, SUNDAY = sql_weekday(0), sql_weekday(5), sql_weekday(6)
RULED = f"'DTSTART;VALUE=DATE:' || strftime({MONDAY}, '%Y%m%d') || chr(10) || 'RRULE:FREQ=WEEKLY;INTERVAL=1;BYDAY=MO;COUNT=3'"
#: phrase: (seq, start, end, open, all day, rule) of each occurrence at nine o'clock of day d
OCCURRENCES = {
    "noel": [("1", sql_next(12, 25), "NULL", "NULL", True, "NULL")], "quốc khánh": [("1", sql_next(9, 2), "NULL", "NULL", True, "NULL")],
    "mùng 2 tết": [("1", f"{sql_lunar(1, 1)} + 1", "NULL", "NULL", True, "NULL")], "rằm tháng 8": [("1", sql_lunar(8, 15), "NULL", "NULL", True, "NULL")],
    "đêm trung thu": [("1", f"{sql_lunar(8, 15)} + INTERVAL 22 HOUR", f"{sql_lunar(8, 15)} + INTERVAL 29 HOUR", "NULL", False, "NULL")],
    "3 ngày sau noel": [("1", f"{sql_next(12, 25)} + 3", "NULL", "NULL", True, "NULL")],
    "từ 10h đến 17h": [("1", "d + INTERVAL 10 HOUR", "d + INTERVAL 17 HOUR", "NULL", False, "NULL")],
    "trước 8h sáng": [("1", "d + 1", "d + INTERVAL 32 HOUR", "'start'", False, "NULL")], "sau 6 giờ chiều": [("1", "d + INTERVAL 18 HOUR", "NULL", "'end'", False, "NULL")],
    "trong 90 phút": [("1", "d + INTERVAL 9 HOUR", "d + INTERVAL 630 MINUTE", "NULL", False, "NULL")],
    "từ thứ hai đến thứ sáu": [("1", MONDAY, f"{MONDAY} + 5", "NULL", True, "NULL")],
    "tháng sau nữa": [("1", "date_trunc('month', d) + INTERVAL 2 MONTH", "date_trunc('month', d) + INTERVAL 3 MONTH", "NULL", True, "NULL")],
    "cuối tuần": [("CASE WHEN isodow(d) = 7 THEN 2 ELSE 1 END", SATURDAY, "NULL", "NULL", True, "NULL"), ("CASE WHEN isodow(d) = 7 THEN 1 ELSE 2 END", SUNDAY, "NULL", "NULL", True, "NULL")],
    "mỗi thứ hai, 3 lần": [(f"{n + 1}", f"{MONDAY} + {7 * n}", "NULL", "NULL", True, RULED) for n in range(3)],
    "giờ hành chính thứ hai": [("1", f"{MONDAY} + INTERVAL 8 HOUR", f"{MONDAY} + INTERVAL 17 HOUR", "NULL", False, "NULL")],
}


def sql_occurrences() -> str:
    one = lambda text, o: f"SELECT d, '{text}' AS text, ({o[0]})::BIGINT AS seq, ({o[1]})::TIMESTAMP AS start, ({o[2]})::TIMESTAMP AS \"end\", {o[3]} AS open, {o[4]} AS all_day, {o[5]} AS rrule FROM o"
    return _sql_moon() + ", o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) " + " UNION ALL ".join(one(t, o) for t, found in OCCURRENCES.items() for o in found)


@query(sql_occurrences())
def phrase_occurrences(spark, sf_dir):
    days = order_days(spark, sf_dir).select("d").distinct()
    rows = days.select("d", F.explode(F.array(*[F.lit(p) for p in OCCURRENCES])).alias("text")).withColumn("ref", F.timestamp_add("HOUR", F.lit(9), F.col("d").cast("timestamp_ntz")))
    found = occurrences_df(rows, "ref", dates.named_days(spark, 1989, 2005))
    return found.select("d", "text", F.col("seq").cast("long").alias("seq"), "start", "end", "open", "all_day", "rrule")


@query(_sql_moon() + "SELECT item, (SELECT min(start + dd - 1) FROM lunar l WHERE l.year = y AND l.month = mm AND dd <= l.len AND (l.leap = (lp AND EXISTS (SELECT 1 FROM lunar z WHERE z.year = y AND z.month = mm AND z.leap)))) AS solar FROM (SELECT o_orderkey AS item, 1993 + (o_orderkey % 10)::INT AS y, (o_orderkey % 12)::INT + 1 AS mm, (o_orderkey % 30)::INT + 1 AS dd, o_orderkey % 2 = 0 AS lp FROM orders)")
def lunar_to_solar(spark, sf_dir):
    k = F.col("o_orderkey")
    part = lambda n, plus: ((k % n) + plus).cast("int")
    rows = table(spark, sf_dir, "orders").select(k.alias("item"), part(10, 1993).alias("y"), part(12, 1).alias("mm"), part(30, 1).alias("dd"), (k % 2 == 0).alias("lp"))
    return dates.to_solar(rows, dates.lunar_days(spark, 1993, 2002), "y", "mm", "dd", "lp").select("item", "solar")


SQL_BUCKET = "CASE WHEN NOT regexp_matches(t, '^[0-9]') THEN 15 WHEN regexp_matches(t, '^0[0-9]') THEN 14 " + " ".join(f"WHEN t::DOUBLE <= {n} THEN {i}" for i, n in enumerate(features.NUMBER_ENDS)) + " ELSE 13 END"


@query(f"SELECT {SQL_BUCKET} AS bucket, count(*) AS n FROM (SELECT unnest({SQL_TOKENS}) AS t FROM documents) GROUP BY 1")
def number_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("t"))
    return rows.groupBy(features.number_bucket(F.col("t")).alias("bucket")).agg(F.count("*").alias("n"))


SQL_FLAGS = " + ".join(
    f"CASE WHEN {c} THEN {1 << i} ELSE 0 END"
    for i, c in enumerate(["regexp_matches(t, '\\p{Lu}')", "regexp_matches(t, '\\p{Lu}') AND t = upper(t)", "regexp_matches(t, '[0-9]')", "p IS NULL", "n IS NULL", "regexp_matches(p, '^\\s')", "regexp_matches(n, '^\\s')", "lower(t) IN ('h', 'g', 'p', 'st', 'nd', 'rd', 'th') AND regexp_matches(p, '^[0-9]')"])
)


@query(f"WITH p AS (SELECT conv_id, turn, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT conv_id, turn, {SQL_TOKENS} AS ts FROM conversations)), q AS (SELECT t, lag(t) OVER w AS p, lead(t) OVER w AS n FROM p WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)) SELECT ({SQL_FLAGS})::BIGINT AS flags, count(*) AS tokens FROM q GROUP BY 1")
def token_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("ts", text.tokens(F.col("text"))).select(F.explode(features.flags(F.col("ts"))).alias("flags"))
    return rows.groupBy(F.col("flags").cast("long").alias("flags")).agg(F.count("*").alias("tokens"))


@query("SELECT n, CASE WHEN n <= 10 THEN w[n + 1] WHEN n < 20 THEN 'mười ' || CASE WHEN n = 15 THEN 'lăm' ELSE w[n - 9] END ELSE w[n // 10 + 1] || ' mươi' || CASE n % 10 WHEN 0 THEN '' WHEN 1 THEN ' mốt' WHEN 4 THEN ' tư' WHEN 5 THEN ' lăm' ELSE ' ' || w[n % 10 + 1] END END AS words, n::DOUBLE AS back FROM (SELECT range AS n, string_split('không một hai ba bốn năm sáu bảy tám chín mười', ' ') AS w FROM range(100))")
def spell_round_trip(spark, sf_dir):
    rows = spark.range(100).select(F.col("id").alias("n"), numerals.spell(F.col("id")).alias("words"))
    return rows.withColumn("back", numerals.spelled_number(F.col("words")))


@query("WITH j AS (SELECT lang, (n_chars > 500) = (quality = 1) AS a, (n_chars > 1500) = (quality = 1) AS b FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (NOT a AND b) AS fixed, count(*) FILTER (a AND NOT b) AS broke FROM j GROUP BY 1) SELECT lang, fixed, broke, CASE WHEN fixed + broke = 0 OR broke <= fixed THEN FALSE ELSE (SELECT sum(exp(lgamma(fixed + broke + 1) - lgamma(k + 1) - lgamma(fixed + broke - k + 1) - (fixed + broke) * ln(2))) FROM range(0, 100000) r(k) WHERE k BETWEEN broke AND fixed + broke) < 0.05 END AS regressed FROM c")
def regression_flips(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    right = lambda n: (F.col("n_chars") > n) == (F.col("quality") == 1)
    return evaluation.flips(rows, right(500), right(1500), [F.col("lang")]).withColumn("regressed", evaluation.regressed(F.col("fixed"), F.col("broke")))
