"""Queries over labelled tokens, features, quantities, policies and rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoframe.functions import civil, features, lexicon, numerals, text
from kairoframe.operators import dates, evaluation, expressions, islands, recurrence, schedule

from . import generate
from .catalog import FIRST_DAYS, QUERIES, SQL, SQL_BUCKET, SQL_FLAGS, SQL_KIND, SQL_TOKENS, first_days, once, order_days, query, table
from .parse import parse_df
from .texts import texts_df

__all__ = ["QUERIES", "SQL"]

IN_FILLER = "lower(t) IN (" + ", ".join(f"'{w}'" for w in expressions.FILLER) + ")"
#: A label of every token by its length and place, so that all ways of joining and cutting occur.
LABELS = [1, 32, 31, 11, 12, 9]
SQL_LABEL = "CASE WHEN kind = 3 OR (length(t) + pos) % 4 <> 0 THEN 0 ELSE list_extract([" + ", ".join(map(str, LABELS)) + "], ((length(t) * 7 + pos) % 6 + 1)::INT) END"
SQL_LABELLED = f"""WITH p AS (SELECT conv_id, turn, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT conv_id, turn, {SQL_TOKENS} AS ts FROM conversations)),
a AS (SELECT *, {SQL_KIND} AS kind, coalesce(sum(length(t)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
b AS (SELECT *, {SQL_LABEL} AS label, pos % 10 = 4 AS mark, ((pos * 37) % 100) / 100 AS score FROM a),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS n FROM b WHERE kind <> 3),
f AS (SELECT conv_id, turn, min(n) AS s FROM w WHERE label <> 0 GROUP BY ALL),
live AS (SELECT w.*, n - lag(n) OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 > 3 AS far FROM w JOIN f USING (conv_id, turn) WHERE n >= s AND (label <> 0 OR {IN_FILLER})),
isl AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY n) AS island FROM live),
rng AS (SELECT conv_id, turn, island, min(n) FILTER (label NOT IN (0, 31, 32)) AS lo, max(n) FILTER (CASE WHEN label = 32 THEN NOT {IN_FILLER} ELSE label NOT IN (0, 31) END) AS hi FROM isl GROUP BY ALL),
e AS (SELECT w.*, lo, island FROM w JOIN rng USING (conv_id, turn) WHERE n BETWEEN lo AND hi)"""


def labelled(spark, sf_dir):
    """Every turn with its tokens as the expression operators take them."""

    def token(t, i, start):
        kind = text.kind(t).cast("int")
        label = F.when((kind == 3) | ((F.length(t) + i) % 4 != 0), 0).otherwise(F.get(F.array(*[F.lit(x) for x in LABELS]), (F.length(t) * 7 + i) % 6))
        return F.struct(
            start.alias("start"), (start + text.units(t)).alias("end"), t.alias("text"), kind.alias("kind"), label.alias("label"),
            (i % 10 == 4).alias("clause_start"), ((i * 37) % 100 / 100).alias("score"),
        )

    rows = table(spark, sf_dir, "conversations").withColumn("ts", text.tokens(F.col("text")))
    rows = rows.withColumn("ss", text.starts(F.col("ts")))
    return rows.select("conv_id", "turn", "text", F.transform("ts", lambda t, i: token(t, i, F.get("ss", i))).alias("tokens"))


def found_expressions(spark, sf_dir):
    return labelled(spark, sf_dir).select("conv_id", "turn", "text", F.explode(expressions.split_expressions(F.col("tokens"))).alias("e"))


@query(SQL_LABELLED + " SELECT conv_id, turn, min(start)::BIGINT AS start, max(start + length(t))::BIGINT AS \"end\", count(*) AS tokens, min(score) FILTER (label NOT IN (0, 31, 32)) AS confidence, min(score) FILTER (label NOT IN (0, 31, 32)) < 0.5 AS unsure, coalesce(string_agg(t, ' ' ORDER BY n) FILTER (label = 0 AND NOT " + IN_FILLER + "), '') AS ignored FROM e GROUP BY conv_id, turn, island")
def labelled_expressions(spark, sf_dir):
    rows = found_expressions(spark, sf_dir).withColumn("s", expressions.summary(F.col("e"), F.col("text")))
    return rows.select("conv_id", "turn", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.size("e").cast("long").alias("tokens"), "s.confidence", "s.unsure", "s.ignored")


@query(SQL_LABELLED + ", blk AS (SELECT *, sum(CASE WHEN n = lo OR mark THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, island ORDER BY n) AS k FROM e), said AS (SELECT conv_id, turn, island, k, min(n) AS first, bool_or(label NOT IN (0, 31, 32)) AS said FROM blk GROUP BY ALL), cuts AS (SELECT *, CASE WHEN k = 1 OR lag(said) OVER (PARTITION BY conv_id, turn, island ORDER BY k) THEN 1 ELSE 0 END AS cut FROM said), num AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id, turn, island ORDER BY k) AS clause FROM cuts) SELECT conv_id, turn, min(blk.start)::BIGINT AS start, count(*) AS tokens FROM blk JOIN num USING (conv_id, turn, island, k) GROUP BY conv_id, turn, island, clause")
def labelled_clauses(spark, sf_dir):
    rows = found_expressions(spark, sf_dir).select("conv_id", "turn", F.explode(expressions.split_clauses(F.col("e"))).alias("c"))
    return rows.select("conv_id", "turn", F.get("c", F.lit(0))["start"].cast("long").alias("start"), F.size("c").cast("long").alias("tokens"))


@query(SQL_LABELLED + ", g AS (SELECT *, lag(label) OVER v AS pl, lag(kind) OVER v AS pk, lag(start + length(t)) OVER v AS pe FROM e WINDOW v AS (PARTITION BY conv_id, turn, island ORDER BY n)), h AS (SELECT *, CASE WHEN pl IS NULL OR label <> pl OR (kind = 1 AND pk = 1) OR label IN (0, 31, 32) THEN 1 ELSE 0 END AS b FROM g), i AS (SELECT *, sum(b) OVER (PARTITION BY conv_id, turn, island ORDER BY n) AS seg FROM h) SELECT conv_id, turn, min(start)::BIGINT AS start, any_value(label)::INT AS role, count(*) AS tokens, lower(string_agg(CASE WHEN b = 0 AND start > pe THEN ' ' ELSE '' END || t, '' ORDER BY n)) AS text FROM i GROUP BY conv_id, turn, island, seg")
def labelled_segments(spark, sf_dir):
    rows = found_expressions(spark, sf_dir).select("conv_id", "turn", F.explode(expressions.segments(F.col("e"))).alias("s"))
    return rows.select("conv_id", "turn", F.get("s.tokens", F.lit(0))["start"].cast("long").alias("start"), "s.role", F.size("s.tokens").cast("long").alias("tokens"), "s.text")


@query(SQL_LABELLED + ", sig AS (SELECT conv_id, turn, sha256(string_agg(label::VARCHAR, ' ' ORDER BY n)) AS signature FROM e GROUP BY conv_id, turn, island), held AS (SELECT DISTINCT signature FROM sig WHERE turn % 2 = 1) SELECT conv_id, turn, signature FROM sig WHERE turn % 2 = 0 AND signature NOT IN (SELECT signature FROM held)")
def signature_split(spark, sf_dir):
    """Expressions of even turns whose pattern of labels no odd turn has."""
    rows = found_expressions(spark, sf_dir).select("conv_id", "turn", evaluation.signature(F.col("e.label")).alias("signature"))
    return evaluation.disjoint(rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1"), "signature")


def sql_date_order(order: str) -> str:
    """The labels (a, b) of the numbers of "a/b/2026", "2026-a-b" and "a.b" under an order."""
    first = f"CASE WHEN y THEN 11 WHEN a > 12 AND b > 12 THEN 12 WHEN a > 12 THEN 12 WHEN b > 12 THEN 11 ELSE {12 if order == 'DMY' else 11} END"
    return f"{first} AS a_{order.lower()}"


@query(f"SELECT o_orderkey, form, {sql_date_order('DMY')}, {sql_date_order('MDY')} FROM (SELECT o_orderkey, form, form = 1 AS y, CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) ELSE month(o_orderdate) END AS a, CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) ELSE day(o_orderdate) END AS b FROM orders, range(0, 3) r(form))")
def numeric_dates(spark, sf_dir):
    day, month = F.dayofmonth("d"), F.month("d")
    even = F.col("o_orderkey") % 2 == 0
    rows = order_days(spark, sf_dir).withColumn("a", F.when(even, day).otherwise(month).cast("string")).withColumn("b", F.when(even, month).otherwise(day).cast("string"))

    def tokens(*parts):
        made = [F.struct(F.lit(i).alias("start"), F.lit(i + 1).alias("end"), w.alias("text"), F.lit(1 if label in (11, 12, 13) else 2).alias("kind"), F.lit(label).alias("label"), F.lit(False).alias("clause_start"), F.lit(1.0).alias("score")) for i, (w, label) in enumerate(parts)]
        return F.array(*made)

    a, b, year = (F.col("a"), 12), (F.col("b"), 12), (F.year("d").cast("string"), 13)
    sign = lambda s: (F.lit(s), 32)
    forms = F.array(*[F.struct(F.lit(i).cast("long").alias("form"), tokens(*p).alias("ts"), F.lit(at).alias("at")) for i, (p, at) in enumerate([((a, sign("/"), b, sign("/"), year), 0), ((year, sign("-"), a, sign("-"), b), 2), ((a, sign("."), b), 0)])])
    rows = rows.select("o_orderkey", F.inline(forms))
    label = lambda order: F.get(expressions.date_order(F.col("ts"), order), F.col("at"))["label"]
    return rows.select("o_orderkey", "form", label("DMY").alias("a_dmy"), label("MDY").alias("a_mdy"))


LOW, BARE = features.without(text.TONES)
MARKED, UNMARKED = features.without(None)
quoted = lambda s: "'" + s.replace("'", "''") + "'"
SQL_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295)"


def sql_class(c: str) -> str:
    base = f"translate(lower({c}), '{LOW}', '{BARE}')"
    return f"CASE WHEN instr('abcdefghijklmnopqrstuvwxyz', {base}) > 0 THEN instr('abcdefghijklmnopqrstuvwxyz', {base}) - 1 WHEN instr('{features.EXTENDED}', {base}) > 0 THEN instr('{features.EXTENDED}', {base}) + 25 WHEN {c} BETWEEN '0' AND '9' THEN unicode({c}) - 15 ELSE 43 + greatest(instr({quoted(features.SIGNS)}, {c}) - 1, 0) % 21 END"


def sql_sign(t: str) -> str:
    known = "[" + ", ".join(quoted(s) for s in features.NEIGHBOURS) + "]"
    return f"CASE WHEN {t} IS NULL OR NOT regexp_matches({t}, '^[^\\p{{L}}0-9\\s]$') THEN 0 ELSE coalesce(list_position({known}, translate({t}, '–—', '--')), 12) END"


SQL_LENGTH = "CASE WHEN length(t)<=1 THEN 0 WHEN length(t)<=2 THEN 1 WHEN length(t)<=3 THEN 2 WHEN length(t)<=4 THEN 3 WHEN length(t)<=6 THEN 4 WHEN length(t)<=8 THEN 5 WHEN length(t)<=12 THEN 6 ELSE 7 END"


@query(
    f"WITH p AS (SELECT conv_id, turn, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT conv_id, turn, {SQL_TOKENS} AS ts FROM conversations)), q AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS n FROM p WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)), "
    f"skel AS (SELECT *, regexp_replace(translate(lower(t), '{MARKED}', '{UNMARKED}'), '[aeiouyăâêôơư]', '', 'g') AS sk FROM q), "
    f"x AS (SELECT conv_id, turn, pos, ({SQL_KIND}) + ({SQL_LENGTH}) * 4 + ({sql_class('t[1]')}) * 32 + ({sql_class('t[-1]')}) * 2048 + (({SQL_FNV.format('lower(t)')}) & 255) * 131072 + ({SQL_BUCKET}) * 33554432 AS identity, "
    f"(CASE WHEN sk = '' THEN 2166136261 ELSE {SQL_FNV.format('sk')} END & 127) + ({SQL_FLAGS}) * 128 + ({sql_sign('p')}) * 32768 + ({sql_sign('n')}) * 524288 AS context FROM skel) "
    "SELECT conv_id, turn, pos::BIGINT AS pos, identity::BIGINT AS identity, context::BIGINT AS context, (9 + bit_count((context >> 7) & 255))::BIGINT AS rows, "
    "(0 + 4 + 12 + 76 + 140 + 396 + 532 + 548 + 564 + (identity & 3) + ((identity >> 2) & 7) + ((identity >> 5) & 63) + ((identity >> 11) & 63) + ((identity >> 17) & 255) + ((identity >> 25) & 15) + (context & 127) + ((context >> 15) & 15) + ((context >> 19) & 15)"
    + "".join(f" + CASE WHEN (context >> {7 + b}) & 1 = 1 THEN {524 + b} ELSE 0 END" for b in range(8))
    + ")::BIGINT AS row_sum FROM (SELECT conv_id, turn, pos, identity::BIGINT AS identity, context::BIGINT AS context FROM x)"
)
def feature_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("ts", text.tokens(F.col("text")))
    rows = rows.select("conv_id", "turn", F.posexplode(features.between(F.col("ts"))).alias("pos", "x")).select("conv_id", "turn", "pos", "x.*")
    rows = rows.withColumn("f", features.features(F.col("t"), F.col("before"), F.col("after"))).withColumn("r", features.feature_rows(F.col("f")))
    total = F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "f.identity", "f.context", F.size("r").cast("long").alias("rows"), total.alias("row_sum"))


@query("SELECT role, count(*) AS n, sum(CASE WHEN regexp_matches(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', '[0-9]| (" + "|".join(lexicon.TIME_PHRASES) + ") ') THEN 1 ELSE 0 END)::BIGINT AS timed FROM conversations GROUP BY role")
def time_phrases(spark, sf_dir):
    timed = lexicon.mentions_time(text.key(F.col("text")))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(timed.cast("long")).alias("timed"))


APART = {"é": "é", "è": "è", "ê": "ê", "ó": "ó", "ñ": "ñ"}


def sql_apart(column: str) -> str:
    for whole, apart in APART.items():
        column = f"replace({column}, '{whole}', '{apart}')"
    return column


@query(f"SELECT doc_id, md5(nfc_normalize(t)) AS digest, length(nfc_normalize(t)) AS chars, length(t) AS source FROM (SELECT doc_id, {sql_apart('text')} AS t FROM documents)")
def composed_texts(spark, sf_dir):
    """Texts that come with their accents apart."""
    apart = F.col("text")
    for whole, parts in APART.items():
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    rows = table(spark, sf_dir, "documents").select("doc_id", apart.alias("t")).withColumn("c", text.composed(F.col("t")))
    return rows.select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("long").alias("chars"), F.length("t").cast("long").alias("source"))


@query("WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders), x AS (SELECT *, w, ((w - (isodow(d) - 1) + 7) % 7)::INT AS ahead, (d - (isodow(d) % 7)::INT) AS sunday, ((w + 1) % 7)::INT AS place FROM o, range(0, 7) r(w)) SELECT o_orderkey, w::INT AS w, sunday + place AS this_su, sunday + place + 7 AS next_su, sunday + place - 14 AS last_su, d + CASE WHEN ahead > 3 THEN ahead - 7 ELSE ahead END AS nearest, d + CASE WHEN ahead = 0 THEN 7 ELSE ahead END AS immediate, date_trunc('week', d)::DATE + w::INT AS this_week FROM x")
def weekday_policies(spark, sf_dir):
    rows = order_days(spark, sf_dir).select("o_orderkey", "d", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("w"))
    at = lambda m, **policy: civil.weekday_near(F.col("d"), F.col("w"), F.lit(m).cast("string"), **policy)
    return rows.select(
        "o_orderkey", "w", at("this", first="SU").alias("this_su"), at("next", first="SU").alias("next_su"), at("last", first="SU", distance=2).alias("last_su"),
        at(None, bare="nearest").alias("nearest"), at("next", following="immediate").alias("immediate"), at(None, bare="thisWeek").alias("this_week"),
    )


@query("WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, date_trunc('month', o_orderdate)::DATE AS m FROM orders), x AS (SELECT *, n, m + (7 * (n - 1))::INT AS s FROM o, range(1, 7) r(n)) SELECT o_orderkey, n::INT AS n, CASE WHEN n <= 5 AND date_trunc('month', s) = m THEN s END AS start, CASE WHEN n <= 5 AND date_trunc('month', s) = m THEN least(s + 7, (m + INTERVAL 1 MONTH)::DATE) END AS \"end\", CASE WHEN n <= 4 THEN make_date(year(d), (3 * n - 2)::INT, 1) END AS quarter FROM x")
def month_weeks(spark, sf_dir):
    rows = order_days(spark, sf_dir).select("o_orderkey", "d", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
    start, end = civil.week_of_month(F.trunc("d", "month"), F.col("n"))
    return rows.select("o_orderkey", "n", start.alias("start"), F.when(start.isNotNull(), end).alias("end"), civil.quarter(F.col("d"), F.col("n"))[0].alias("quarter"))


@query("SELECT o_orderkey, k::INT AS k, CASE WHEN ceil(greatest(behind, 0) / (86400.0 * step)) < 8 THEN wall + INTERVAL 1 DAY * (ceil(greatest(behind, 0) / (86400.0 * step)) * step)::INT END AS at FROM (SELECT o_orderkey, k, CASE WHEN k = 2 THEN 7 ELSE 1 END AS step, d - INTERVAL 5 DAY * k + INTERVAL 8 HOUR AS wall, epoch(d + INTERVAL 9 HOUR) - epoch(d - INTERVAL 5 DAY * k + INTERVAL 8 HOUR) AS behind FROM (SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP AS d FROM orders), range(0, 3) r(k))")
def rolled_forward(spark, sf_dir):
    rows = order_days(spark, sf_dir).select("o_orderkey", F.col("d").cast("timestamp_ntz").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    at = F.timestamp_add("HOUR", 8 - 120 * F.col("k"), "d")
    ref = F.timestamp_add("HOUR", F.lit(9), "d")
    return rows.select("o_orderkey", "k", F.when(F.col("k") == 2, civil.rolled(at, ref, 7)).otherwise(civil.rolled(at, ref, 1)).alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) - CASE WHEN event_id % 3 = 1 THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END END::TIMESTAMP AS at FROM events")
def strict_instants(spark, sf_dir):
    kind = F.col("event_id") % 3
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(kind == 0, "Z").when(kind == 1, "+07:00").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", civil.instant(written).cast("timestamp_ntz").alias("at"))


@query("WITH w AS (SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 150 MINUTE AS wall FROM orders), a AS (SELECT *, timezone('America/New_York', wall) AS ins FROM w) SELECT o_orderkey, CASE WHEN timezone('America/New_York', ins) = wall THEN timezone('UTC', ins) END AS at, CASE WHEN timezone('America/New_York', ins) <> wall THEN 'nonexistent-time' END AS diagnostic FROM a")
def strict_clocks(spark, sf_dir):
    wall = F.timestamp_add("MINUTE", F.lit(150), F.date_trunc("day", F.col("o_orderdate").cast("timestamp_ntz"))).cast("timestamp")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", civil.at_time(wall, F.lit("America/New_York")).alias("x"))
    return rows.select("o_orderkey", F.col("x.at").cast("timestamp_ntz").alias("at"), "x.diagnostic")


DURATIONS = {
    "tiếng rưỡi": ("n + 0.5", "'hour'"), "phút": ("n", "'minute'"), "quý": ("3 * n", "'month'"), "tuần rưỡi": ("NULL", "NULL"), "ngày": ("n", "'day'"),
}


@query(
    "WITH k AS (SELECT o_orderkey, (o_orderkey % 99 + 1)::DOUBLE AS n FROM orders) "
    + " UNION ALL ".join(f"SELECT o_orderkey, '{u}' AS unit_text, {a}::DOUBLE AS amount, {u_} AS unit, CASE WHEN {a} IS NULL THEN NULL ELSE 2 END AS parts, CASE WHEN {a} IS NOT NULL THEN n / 10 + 0.5 END::DOUBLE AS more FROM k" for u, (a, u_) in DURATIONS.items())
)
def spelled_durations(spark, sf_dir):
    """A spelled number and a unit, then a decimal number of hours."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 99 + 1).alias("n"))
    return once(rows, ["n"], read_durations, few=True).drop("n")  # there are 99 numbers


def read_durations(numbers: DataFrame) -> DataFrame:
    """(n, unit_text, amount, unit, parts, more): each number said with each unit and read again."""
    n = F.col("n")
    decimal = F.concat(F.floor(n / 10).cast("string"), F.lit(","), (n % 10).cast("string"))
    rows = numbers.select("n", decimal.alias("x"), F.explode(F.array(*[F.lit(u) for u in DURATIONS])).alias("unit_text"))
    said = F.concat_ws(" ", numerals.spell(F.col("n")), "unit_text", "x", F.lit("giờ"))
    said = F.concat(F.regexp_replace(said, r" (\d+),(\d) giờ$", ""), F.lit(" "), F.col("x"), F.lit(" giờ"))
    rows = rows.withColumn("ds", numerals.durations(said)).withColumn("tenths", F.col("n") / 10)
    first, second = F.get("ds", F.lit(0)), F.get("ds", F.lit(1))
    more = F.when(second["unit"] == "hour", F.round(second["amount"] + 0.5, 6))
    return rows.select("n", "unit_text", first["amount"].alias("amount"), first["unit"].alias("unit"), F.when(F.col("ds").isNotNull(), F.size("ds")).alias("parts"), more.alias("more"))


@query("WITH c AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1), h AS (SELECT k, d, d::TIMESTAMP + INTERVAL 1 HOUR * i AS t FROM c, range(9, 9 + 24 * 7 + 1, 2) r(i)) SELECT k, t AS at FROM h WHERE hour(t) IN (9, 13, 17) AND isodow(t) <= 5")
def recur_hourly(spark, sf_dir):
    start = F.timestamp_add("HOUR", F.lit(9), F.col("d").cast("timestamp_ntz"))
    found = recurrence.hourly(start, F.timestamp_add("DAY", F.lit(7), start), 2, [9, 13, 17], [0, 1, 2, 3, 4])
    return first_days(spark, sf_dir).select("k", F.explode(found).alias("at"))


@query("WITH c AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1) SELECT k, d + i::INT + INTERVAL 1 HOUR * h AS at FROM c, range(0, 7) r(i), (VALUES (0), (4), (9), (14), (19)) s(h)")
def recur_times_a_day(spark, sf_dir):
    daily = recurrence.days(F.col("d"), F.date_add("d", 6))
    return first_days(spark, sf_dir).select("k", F.explode(recurrence.at_hours(daily, recurrence.times_per_day(5))).alias("at"))


@query(FIRST_DAYS + ", s AS (SELECT k, a, d, row_number() OVER (PARTITION BY k ORDER BY d) AS n FROM days WHERE isodow(d) = 1 AND day(d) > 7 AND month(d) NOT IN (7, 8)) SELECT k, d AS day FROM s WHERE n <= 20 AND d >= a + 30")
def recur_count_except(spark, sf_dir):
    """Twenty Mondays but the first of each month and those of July and August; shown from the thirtieth day on."""
    out = lambda d: recurrence.is_ordinal(d, 0, 1) | F.month(d).isin(7, 8)
    mondays = recurrence.weekly(F.col("d"), F.date_add("d", 365), [0])
    return first_days(spark, sf_dir).select("k", F.explode(recurrence.counted(mondays, out, 20, F.date_add("d", 30))).alias("day"))


@query("WITH c AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1) SELECT k, (SELECT min(d + i::INT) FROM range(0, 2928) r(i) WHERE day(d + i::INT) = 31 AND month(d + i::INT) NOT IN (1, 3) AND isodow(d + i::INT) = 7) AS first FROM c")
def recur_seed(spark, sf_dir):
    """The first 31st that is a Sunday, outside January and March."""
    sundays = lambda end: F.filter(recurrence.monthly(F.col("d"), end, [31]), lambda d: F.weekday(d) == 6)
    return first_days(spark, sf_dir).select("k", recurrence.seeded(sundays, F.col("d"), lambda d: F.month(d).isin(1, 3)).alias("first"))


@query("WITH c AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1) SELECT k, 'DTSTART;TZID=Asia/Ho_Chi_Minh:' || strftime(d, '%Y%m%d') || 'T080000' || chr(10) || 'DTEND;TZID=Asia/Ho_Chi_Minh:' || strftime(d, '%Y%m%d') || 'T093000' || chr(10) || 'RRULE:FREQ=DAILY;INTERVAL=1;WKST=SU;BYMONTH=1,7;BYHOUR=8,20;COUNT=' || CASE WHEN k % 3 = 0 THEN 10 ELSE 12 END || CASE WHEN k % 3 = 0 THEN '' ELSE chr(10) || 'EXDATE;TZID=Asia/Ho_Chi_Minh:' || strftime(d + 1, '%Y%m%d') || 'T080000,' || strftime(d + 2, '%Y%m%d') || 'T080000' END AS timed, 'DTSTART;VALUE=DATE:' || strftime(d, '%Y%m%d') || chr(10) || 'DTEND;VALUE=DATE:' || strftime(d + 2, '%Y%m%d') || chr(10) || 'RRULE:FREQ=MONTHLY;INTERVAL=1;BYDAY=MO;BYSETPOS=2,3,4,5;UNTIL=' || strftime(d + 90, '%Y%m%d') AS whole FROM c")
def rrule_lines(spark, sf_dir):
    at = lambda days, minutes: F.timestamp_add("MINUTE", F.lit(days * 1440 + minutes), F.col("d").cast("timestamp_ntz"))
    out = F.when(F.col("k") % 3 != 0, F.array(at(1, 480), at(2, 480))).otherwise(F.expr("cast(array() as array<timestamp_ntz>)"))
    timed = recurrence.rrule(at(0, 480), "DAILY", count=10, zone="Asia/Ho_Chi_Minh", end=at(0, 570), week_start="SU", by_month=[1, 7], by_hour=[8, 20], excluded=out)
    whole = recurrence.rrule(F.col("d"), "MONTHLY", by_day=["MO"], by_set_pos=[2, 3, 4, 5], until=F.date_add("d", 90), end=F.date_add("d", 2))
    return first_days(spark, sf_dir).select("k", timed.alias("timed"), whole.alias("whole"))


@query("SELECT o_orderkey, CASE WHEN r1 AND NOT r2 THEN 'a' ELSE CASE WHEN r1 THEN 'a' END END AS first, CASE WHEN r2 THEN 'b' WHEN r1 AND NOT r2 AND bare THEN 'a' END AS second FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS r1, o_orderkey % 3 = 0 AS r2, o_orderkey % 5 <> 0 AS bare FROM orders)")
def shared_rules(spark, sf_dir):
    """Two clauses: the first may have rule a, the second rule b, and a day of its own."""
    k = F.col("o_orderkey")
    clause = lambda rule, date: F.struct(rule.alias("recurrence"), date.alias("date"), F.lit(None).cast("string").alias("shift"), F.lit("8h").alias("time"))
    clauses = F.array(clause(F.when(k % 2 == 0, "a"), F.lit("d")), clause(F.when(k % 3 == 0, "b"), F.when(k % 5 == 0, "d")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", expressions.share_recurrence(clauses).alias("c"))
    return rows.select("o_orderkey", F.get("c", F.lit(0))["recurrence"].alias("first"), F.get("c", F.lit(1))["recurrence"].alias("second"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS near, (o_orderkey % 60)::INT AS cycle, (SELECT arg_min(y, abs(y - near) * 2 - CASE WHEN y > near THEN 1 ELSE 0 END) FROM range(1900, 2100) r(y) WHERE (y - 4) % 60 = o_orderkey % 60)::INT AS year FROM (SELECT o_orderkey, o_orderdate, year(o_orderdate) AS near FROM orders)")
def nearest_cycle_year(spark, sf_dir):
    rows = order_days(spark, sf_dir).select("o_orderkey", F.year("d").alias("near"), (F.col("o_orderkey") % 60).cast("int").alias("cycle"))
    return rows.withColumn("year", dates.cycle_year(F.col("cycle"), F.col("near")).cast("int"))


@query("SELECT family, count(*) AS n, sum(CASE WHEN list_slice(actual, 1, len(expected)) = expected THEN 1 ELSE 0 END)::BIGINT AS agree FROM (SELECT o_orderpriority AS family, range(0, o_orderkey % 4) AS expected, range(0, o_orderkey % 5) AS actual FROM orders) GROUP BY 1")
def prefix_agreement(spark, sf_dir):
    upto = lambda n: F.slice(F.array(*[F.lit(i) for i in range(5)]), 1, n)
    k = F.col("o_orderkey")
    right = evaluation.prefix_agrees(upto((k % 4).cast("int")), upto((k % 5).cast("int")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(F.count("*").alias("n"), F.sum(right.cast("long")).alias("agree"))


@query(f"SELECT CASE WHEN n <= 32 THEN 32 WHEN n <= 64 THEN 64 WHEN n <= 128 THEN 128 END AS bucket, count(*) AS texts FROM (SELECT len({SQL_TOKENS}) AS n FROM conversations) WHERE n > 0 GROUP BY 1")
def length_batches(spark, sf_dir):
    n = F.size(text.tokens(F.col("text")))
    rows = table(spark, sf_dir, "conversations").select(n.alias("n")).where("n > 0")
    return rows.groupBy(islands.length_batch(F.col("n")).alias("bucket")).agg(F.count("*").alias("texts"))


@query("SELECT o_orderkey, d + 1 AS first, CASE WHEN d + 3 > d + 1 THEN d + 3 END AS last FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def weekly_spans(spark, sf_dir):
    """The days after tomorrow's to the third: a range of weekdays over the week's end as excluded days leave it."""
    d = F.col("d")
    kept = F.filter(recurrence.days(d, F.date_add(d, 6)), lambda x: F.datediff(x, d).isin(recurrence.excluded_weekdays(1, 3)))
    return order_days(spark, sf_dir).select("o_orderkey", F.array_min(kept).alias("first"), F.array_max(kept).alias("last"))


#: For each specification: kind, its fields, and (start, end) in SQL at nine o'clock of day d with parameter k; NULL starts give no row.
SPECS = [
    (dict(kind="now"), "t", "NULL"),
    (dict(kind="relativeDay", offset="k % 9 - 4"), "d + (k % 9 - 4)::INT", "NULL"),
    (dict(kind="weekdayRange", weekday="k % 7", until_weekday="k % 5"), "d + ((k % 7 - isodow(d) + 8) % 7)::INT", "d + ((k % 7 - isodow(d) + 8) % 7)::INT + ((k % 5 - k % 7 + 7) % 7)::INT + 1"),
    (dict(kind="calendar", month="k % 12 + 1", day="k % 28 + 1"), "CASE WHEN make_date(year(d), (k % 12 + 1)::INT, (k % 28 + 1)::INT) < d THEN make_date(year(d) + 1, (k % 12 + 1)::INT, (k % 28 + 1)::INT) ELSE make_date(year(d), (k % 12 + 1)::INT, (k % 28 + 1)::INT) END", "NULL"),
    (dict(kind="calendar", year="k % 5 + 1990", month="2", day="k % 3 + 27"), "try_cast((k % 5 + 1990) || '-02-' || (k % 3 + 27) AS DATE)", "NULL"),
    (dict(kind="calendarPeriod", month="k % 12 + 1", week="k % 6 + 1"), "CASE WHEN k % 6 < 5 AND month(m + (7 * (k % 6))::INT) = month(m) THEN m + (7 * (k % 6))::INT END", "least(m + (7 * (k % 6) + 7)::INT, (m + INTERVAL 1 MONTH)::DATE)"),
    (dict(kind="calendarPeriod", month="k % 12 + 1", modifier="'next'", edge="'end'"), "last_day(make_date(year(d) + CASE WHEN k % 12 + 1 <= month(d) THEN 1 ELSE 0 END, (k % 12 + 1)::INT, 1))", "NULL"),
    (dict(kind="relativeUnit", unit="'month'", modifier="'last'", distance="k % 3 + 1"), "date_trunc('month', d) - INTERVAL 1 MONTH * (k % 3 + 1)::INT", "date_trunc('month', d) - INTERVAL 1 MONTH * (k % 3)::INT"),
    (dict(kind="relativeUnit", unit="'hour'", modifier="'next'", edge="'end'"), "t + INTERVAL 2 HOUR - INTERVAL 1 SECOND", "NULL"),
    (dict(kind="ordinalWeekday", ordinal="k % 5 + 1", weekday="k % 7"), "CASE WHEN month(o) = month(d) THEN o END", "NULL"),
    (dict(kind="calendarRange", month="11", day="k % 30 + 1", to_month="2", to_day="k % 28 + 1"), "make_date(year(d), 11, (k % 30 + 1)::INT)", "make_date(year(d) + 1, 2, (k % 28 + 1)::INT) + 1"),
]


def sql_specs() -> str:
    month = "CASE WHEN make_date(year(d), (k % 12 + 1)::INT, 1) + INTERVAL 1 MONTH <= d THEN make_date(year(d) + 1, (k % 12 + 1)::INT, 1) ELSE make_date(year(d), (k % 12 + 1)::INT, 1) END"
    ordinal = "date_trunc('month', d)::DATE + ((k % 7 - isodow(date_trunc('month', d)) + 8) % 7)::INT + (7 * (k % 5))::INT"
    rows = f"WITH o AS (SELECT *, {month} AS m, {ordinal} AS o FROM (SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_orderdate::DATE + INTERVAL 9 HOUR AS t FROM orders)) "
    one = lambda i, s: f"SELECT k, {i} AS spec, ({s[1]})::TIMESTAMP AS start, ({s[2]})::TIMESTAMP AS \"end\" FROM o WHERE ({s[1]}) IS NOT NULL"
    return rows + " UNION ALL ".join(one(i, s) for i, s in enumerate(SPECS))


@query(sql_specs())
def resolved_specs(spark, sf_dir):
    """Every kind of date specification with parameters from each order, at nine o'clock of its day."""
    made = [schedule.spec(**{n: F.lit(v) if n == "kind" else F.expr(v) for n, v in fields.items()}) for fields, *_ in SPECS]
    rows = order_days(spark, sf_dir).withColumnRenamed("o_orderkey", "k").withColumn("ref", F.timestamp_add("HOUR", F.lit(9), F.col("d").cast("timestamp_ntz")))
    rows = rows.select("k", "ref", F.posexplode(F.array(*made)).alias("spec", "s"))
    return rows.select("k", "spec", F.inline(schedule.resolve_dates(F.col("s"), F.col("ref"))))


def sql_generated() -> str:
    """What the generator says, by its rule."""
    g = generate
    listed = lambda values: "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"
    pick = lambda values, at: f"list_extract({listed(values)}, (({at}) % {len(values)} + 1)::INT)"
    day = "TIMESTAMP '2026-09-17 00:00:00'"
    ref = "TIMESTAMP '2026-09-17 09:00:00'"
    words = "string_split('không một hai ba bốn năm sáu bảy tám chín mười', ' ')"
    amount = f"CASE WHEN n <= 10 THEN {words}[n + 1] WHEN n = 20 THEN 'hai mươi' WHEN n = 15 THEN 'mười lăm' ELSE 'mười ' || {words}[n - 9] END"
    families = {
        "relative_day": (pick([w for w, _ in g.DAYS], "k"), f"{day} + INTERVAL 1 DAY * {pick([n for _, n in g.DAYS], 'k')}"),
        "weekday": (f"{pick(g.WEEKDAYS, 'k')} || ' tuần ' || {pick([w for w, *_ in g.STEPS], 'k // 7')}", f"TIMESTAMP '2026-09-14' + INTERVAL 1 DAY * (k % 7 + 7 * {pick([n for *_, n in g.STEPS], 'k // 7')})::INT"),
        "clock": (f"(k % 10 + 1) || ' giờ ' || {pick([w for w, _ in g.PARTS], 'k // 10')} || ' mai'", f"{day} + INTERVAL 1 DAY + INTERVAL 1 HOUR * CASE WHEN (k // 10) % 3 = 0 THEN k % 10 + 1 ELSE k % 10 + 13 END"),
        "shift": (f"{amount} || ' ' || {pick([w for w, _ in g.SHIFTS], 'k // 20')} || ' nữa'", f"CASE (k // 20) % 4 WHEN 0 THEN {ref} + INTERVAL 1 MINUTE * n WHEN 1 THEN {ref} + INTERVAL 1 HOUR * n WHEN 2 THEN {ref} + INTERVAL 1 DAY * n ELSE {ref} + INTERVAL 7 DAY * n END"),
        "unit": (f"{pick([w for w, _ in g.UNITS], 'k')} || ' ' || {pick([w for w, *_ in g.STEPS], 'k // 3')}", "CASE k % 3 " + " ".join(f"WHEN {i} THEN date_trunc('{u}', {day}) + INTERVAL 1 {u} * {pick([n for *_, n in g.STEPS], 'k // 3')}" for i, (_, u) in enumerate(g.UNITS)) + " END"),
        "part": (f"{pick([w for w, _ in g.PARTS], 'k')} || ' mai'", f"{day} + INTERVAL 1 DAY + INTERVAL 1 HOUR * {pick([civil.PART_HOURS[p][0] for _, p in g.PARTS], 'k')}"),
    }
    rows = f"WITH i AS (SELECT range AS id, {pick(g.FAMILIES, 'range')} AS family, range // {len(g.FAMILIES)} AS k, (range // {len(g.FAMILIES)}) % 20 + 1 AS n FROM range(6000)) "
    return rows + " UNION ALL ".join(f"SELECT id, family, {text} AS text, ({start})::TIMESTAMP AS start, TRUE AS agrees FROM i WHERE family = '{name}'" for name, (text, start) in families.items())


@query(sql_generated())
def generated_phrases(spark, sf_dir):
    """Phrases by rule, each parsed again: does the parser give what the rule meant?"""
    rows = generate.phrases(spark, 6000, F.lit("2026-09-17 09:00:00")).withColumnRenamed("start", "meant")
    found = parse_df(rows, "ref")
    return found.select("id", "family", "text", F.col("meant").alias("start"), F.col("start").eqNullSafe(F.col("meant")).alias("agrees"))


@query(sql_generated().replace("range(6000)", "range(1200)").replace("SELECT id, family, ", "SELECT id // 2 AS id, ").replace(" AS text, ", " AS said, ").replace(", TRUE AS agrees", ""))
def text_expressions(spark, sf_dir):
    """Two generated phrases in each text, found again with their beginnings."""
    one = generate.phrases(spark, 1200, F.lit("2026-09-17 09:00:00"))
    said = one.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("n"), "text"))).alias("ts"), F.first("ref").alias("ref"))
    rows = said.select("id", "ref", F.concat(F.lit("nhớ "), F.array_join("ts.text", ", hoặc "), F.lit(" nhé")).alias("text"))
    return texts_df(rows, "id", "ref").select("id", "said", "start")
