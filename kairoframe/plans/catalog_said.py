"""Queries over labels of real text and what they compile to, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoframe.functions import labels
from kairoframe.operators.compile import compile_df

from .catalog import once, query, table
from .resolve import resolve_df

#: Sentences that are put behind a turn of a conversation, and the labels of their words by number.
PLANTED = [
    ("hẹn lúc 7h30 tối mai", [0, 0, 14, 32, 15, 17, 7]), ("thứ ba tuần sau nữa", [9, 9, 3, 8, 8]), ("ngày 4 tháng năm năm 2031", [32, 12, 32, 11, 32, 13]), ("tối đa năm người", [0, 0, 0, 0]),
    ("mỗi thứ tư từ 9h đến 11h trừ cuối tuần", [22, 9, 9, 20, 14, 32, 21, 14, 32, 29, 10, 10]), ("đi qua cầu rồi rẽ trái", [0, 0, 0, 0, 0, 0]), ("hai mươi hai ngày trước", [1, 1, 1, 3, 4]), ("hoa mai nở", [0, 0, 0]),
]
WORD = r"[\p{L}]+|[0-9]+"


@query(
    "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{text}', {names})" for k, (text, names) in enumerate(PLANTED)) + ") t(k, said, names)), "
    f"p AS (SELECT conv_id, turn, regexp_extract_all(said, '{WORD}') AS ws, names FROM conversations JOIN s ON k = (conv_id + turn) % {len(PLANTED)}) "
    "SELECT conv_id, turn, unnest(range(len(ws)))::INT AS place, unnest(ws) AS word, unnest(names)::INT AS label FROM p"
)
def planted_labels(spark, sf_dir):
    """Every turn with a sentence behind it: the labels of that sentence's words, whatever the turn says."""
    said = F.get(F.array(*[F.lit(text) for text, _ in PLANTED]), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(PLANTED))).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(". "), said).alias("text"), F.regexp_count(said, F.lit(WORD)).alias("n"))
    words = F.filter("tokens", lambda t: t["kind"] != 3)
    found = labels.label_df(rows, "text").select("conv_id", "turn", F.posexplode(F.slice(words, F.size(words) - F.col("n") + 1, F.col("n"))).alias("place", "t"))
    return found.select("conv_id", "turn", "place", F.col("t.text").alias("word"), F.col("t.label").cast("int").alias("label"))


WEEKDAY_WORDS = ["thứ hai", "thứ ba", "thứ tư", "thứ năm", "thứ sáu", "thứ bảy", "chủ nhật"]
CODES = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
#: What is said about an order, by family; {d} {m} {y} are its date, {h} an hour, {n} a number, {w} a weekday.
FAMILIES = ["họp {h}h15 ngày {d}/{m}/{y} nhé", "mỗi {w} lúc {h} giờ, {n} lần", "giao sau {n} ngày", "từ ngày {d}/{m} đến 31/12/{y}", "gọi lúc {bad} giờ", "tối đa {n} người", "cứ {n} tuần một lần"]


@query(
    "WITH o AS (SELECT o_orderkey, extract(day FROM o_orderdate)::INT AS d, extract(month FROM o_orderdate)::INT AS m, extract(year FROM o_orderdate)::INT AS y, (o_custkey % 9 + 13)::INT AS h, (o_custkey % 30 + 2)::INT AS n, "
    f"{CODES!r}[(o_custkey % 7 + 1)::INT] AS w, o_orderkey % 7 AS f FROM orders) "
    "SELECT o_orderkey, CASE f WHEN 0 THEN 'calendar' WHEN 3 THEN 'calendarRange' END AS kind, CASE WHEN f IN (0, 3) THEN d END AS day, CASE WHEN f IN (0, 3) THEN m END AS month, CASE WHEN f IN (0, 3) THEN y END AS year, "
    "CASE WHEN f = 3 THEN 31 END AS last_day, CASE WHEN f IN (0, 1) THEN h END AS hour, CASE f WHEN 0 THEN 15 WHEN 1 THEN 0 END AS minute, CASE WHEN f IN (1, 6) THEN 'weekly' END AS freq, CASE f WHEN 1 THEN 1 WHEN 6 THEN n END AS \"interval\", "
    "CASE WHEN f = 1 THEN w END AS by_day, CASE WHEN f = 1 THEN n END AS times, CASE WHEN f = 2 THEN n::DOUBLE END AS amount, CASE WHEN f = 2 THEN 'after' END AS direction, CASE f WHEN 4 THEN 'invalid-time' WHEN 5 THEN 'no-expression' END AS code FROM o"
)
def compiled_clauses(spark, sf_dir):
    """What is said about each order, labelled and compiled to the fields of its clause."""
    orders = table(spark, sf_dir, "orders")
    number = F.pmod("o_custkey", F.lit(30)) + 2
    given = {
        "{d}": F.dayofmonth("o_orderdate"), "{m}": F.month("o_orderdate"), "{y}": F.year("o_orderdate"), "{h}": F.pmod("o_custkey", F.lit(9)) + 13, "{n}": number, "{bad}": number + 25,
        "{w}": F.get(F.array(*[F.lit(w) for w in WEEKDAY_WORDS]), F.pmod("o_custkey", F.lit(7)).cast("int")),
    }
    said = F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.pmod("o_orderkey", F.lit(len(FAMILIES))).cast("int"))
    for name, value in given.items():
        said = F.replace(said, F.lit(name), value.cast("string"))
    first = lambda field: F.coalesce(f"c.date.{field}", f"c.date.from.{field}")
    compiled = lambda texts: compile_df(labels.label_df(texts, "text")).withColumn("c", F.get("clauses", F.lit(0))).select(
        "text", F.col("c.date.kind").alias("kind"), first("day").alias("day"), first("month").alias("month"), F.coalesce("c.date.year", "c.date.to.year").alias("year"), F.col("c.date.to.day").alias("last_day"),
        F.col("c.time.start.hour").alias("hour"), F.col("c.time.start.minute").alias("minute"), F.col("c.recurrence.freq").alias("freq"), F.col("c.recurrence.interval").alias("interval"), F.array_join("c.recurrence.by_day", ",").alias("by_day"),
        F.col("c.recurrence.count").alias("times"), F.col("c.shift.amount").alias("amount"), F.col("c.shift.direction").alias("direction"), F.get("diagnostics", F.lit(0)).alias("code"),
    )
    return once(orders.select("o_orderkey", said.alias("text")), ["text"], compiled).drop("text")  # many orders say the same


#: What is said of each order by number, the last without a time.
SAID = ["8h tối mai", "thứ năm lúc 8 giờ sáng", "thứ hai tuần sau", "từ 10h đến 11h30 sáng mai", "3 ngày nữa", "tháng sau", "mỗi thứ tư lúc 9 giờ sáng, 2 lần", "cuối tuần", "2 tiếng 15 phút nữa", "trời hôm đó rất đẹp"]


@query(
    f"WITH o AS (SELECT o_orderkey, date_trunc('day', o_orderdate) AS d, isodow(o_orderdate) - 1 AS w, o_orderkey % {len(SAID)} AS f FROM orders), "
    "x(o_orderkey, s, e, a) AS (SELECT o_orderkey, d + INTERVAL 44 HOUR, NULL, false FROM o WHERE f = 0 UNION ALL SELECT o_orderkey, d + INTERVAL 1 DAY * ((2 - w + 7) % 7 + 1) + INTERVAL 8 HOUR, NULL, false FROM o WHERE f = 1 "
    "UNION ALL SELECT o_orderkey, d + INTERVAL 1 DAY * (7 - w), NULL, true FROM o WHERE f = 2 UNION ALL SELECT o_orderkey, d + INTERVAL 34 HOUR, d + INTERVAL 2130 MINUTE, false FROM o WHERE f = 3 "
    "UNION ALL SELECT o_orderkey, d + INTERVAL 81 HOUR, NULL, false FROM o WHERE f = 4 UNION ALL SELECT o_orderkey, date_trunc('month', d) + INTERVAL 1 MONTH, date_trunc('month', d) + INTERVAL 2 MONTH, true FROM o WHERE f = 5 "
    "UNION ALL SELECT o_orderkey, d + INTERVAL 1 DAY * ((2 - w + 7) % 7 + 7 * i) + INTERVAL 9 HOUR, NULL, false FROM o, (VALUES (0), (1)) v(i) WHERE f = 6 "
    "UNION ALL SELECT o_orderkey, d + INTERVAL 1 DAY * ((i - w + 7) % 7), NULL, true FROM o, (VALUES (5), (6)) v(i) WHERE f = 7 UNION ALL SELECT o_orderkey, d + INTERVAL 675 MINUTE, NULL, false FROM o WHERE f = 8) "
    'SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY s) - 1)::INT AS seq, s::TIMESTAMP AS start, e::TIMESTAMP AS "end", a AS all_day FROM x'
)
def resolved_clauses(spark, sf_dir):
    """What is said of each order, through labels and clauses to when that is from nine o'clock of the order's day on."""
    said = F.get(F.array(*[F.lit(s) for s in SAID]), F.pmod("o_orderkey", F.lit(len(SAID))).cast("int"))
    nine = F.timestamp_add("HOUR", F.lit(9), F.date_trunc("day", F.col("o_orderdate").cast("timestamp_ntz"))).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", nine.alias("ref"), said.alias("text"))
    resolved = lambda pairs: resolve_df(once(pairs, ["text"], lambda texts: compile_df(labels.label_df(texts, "text")).select("text", "clauses")), "ref").select("text", "ref", "occurrences")
    found = once(rows, ["text", "ref"], resolved)  # many orders of a day say the same
    return found.select("o_orderkey", F.posexplode("occurrences").alias("seq", "o")).select("o_orderkey", "seq", "o.start", "o.end", "o.all_day")
