from datetime import date, datetime

from pyspark.sql import functions as F

from kairoframe.functions import lunar, numerals, text
from kairoframe.operators import recurrence
from kairoframe.plans.parse import parse_df


def test_tokens_are_lossless_and_offsets_count_utf16(spark):
    rows = spark.createDataFrame([("thứ hai 15h30 🎉 ok",), ("",)], "t string")
    found = rows.select("t", text.tokens(F.col("t")).alias("ts")).withColumn("s", text.starts(F.col("ts"))).collect()
    assert ["".join(r["ts"]) for r in found] == [r["t"] for r in found]
    assert found[0]["s"] == [0, 3, 4, 7, 8, 10, 11, 13, 14, 16, 17]


def test_tet_follows_the_published_table(spark):
    months = lunar.lunar_months(spark, 2023, 2026).where("month = 1 and not leap").orderBy("year")
    found = [r[0] for r in months.select(F.date_from_unix_date(F.col("start_jdn") - 2440588)).collect()]
    assert found == [date(2023, 1, 22), date(2024, 2, 10), date(2025, 1, 29), date(2026, 2, 17)]


def test_spelled_numbers(spark):
    rows = spark.createDataFrame([("hai mươi mốt", 21.0), ("hai ba", None), ("trăm rưỡi", 100.5)], "t string, n double")
    assert all(r[0] == r[1] for r in rows.select(numerals.spelled_number(F.col("t")).alias("x"), "n").collect())


def test_phrases_resolve(spark):
    rows = spark.createDataFrame([("3 giờ chiều mai",), ("thứ hai tuần sau",), ("25h",), (None,)], "text string")
    rows = rows.withColumn("ref", F.lit("2026-09-17 09:00:00").cast("timestamp_ntz"))
    found = parse_df(rows, "ref").collect()
    assert [r["start"] for r in found] == [datetime(2026, 9, 18, 15), datetime(2026, 9, 21), None, None]
    assert [r["diagnostic"] for r in found] == [None, None, "invalid-time", "no-expression"]


def test_weekly_rules_against_dateutil(spark):
    from dateutil.rrule import MO, TH, WEEKLY, rrule

    start = date(2026, 1, 7)
    got = spark.range(1).select(recurrence.weekly(F.lit(start), F.lit(date(2026, 6, 1)), [0, 3], 2).alias("d")).head()[0]
    want = rrule(WEEKLY, interval=2, byweekday=[MO, TH], dtstart=datetime(2026, 1, 7), until=datetime(2026, 6, 1))
    assert got == [d.date() for d in want]


def test_all_occurrences_of_a_text(spark):
    from kairoframe.operators import dates
    from kairoframe.plans.phrases import occurrences_df

    wanted = {
        "tết": [(datetime(2027, 2, 6), None, None, True)],
        "đầu tháng 11": [(datetime(2026, 11, 1), None, None, True)],
        "từ ngày 16 đến ngày 20": [(datetime(2026, 9, 16), datetime(2026, 9, 21), None, True)],  # began before today
        "thứ năm 8h và thứ sáu 14h": [(datetime(2026, 9, 24, 8), None, None, False), (datetime(2026, 9, 18, 14), None, None, False)],
        "10/20/2026": [(datetime(2026, 10, 20), None, None, True)],
        "mỗi 2 tuần thứ ba, 2 lần": [(datetime(2026, 9, 22), None, None, True), (datetime(2026, 10, 6), None, None, True)],
        "trước 10h": [(datetime(2026, 9, 17), datetime(2026, 9, 17, 10), "start", False)],
        "29/2/2027": [(None, None, None, None)],
        "tuần 2 tháng 3": [(datetime(2027, 3, 8), datetime(2027, 3, 15), None, True)],
        "tuần 5 tháng 2": [(None, None, None, None)],
        "quý 4": [(datetime(2026, 10, 1), datetime(2027, 1, 1), None, True)],
        "quý 1": [(datetime(2027, 1, 1), datetime(2027, 4, 1), None, True)],
        "bây giờ": [(datetime(2026, 9, 17, 9), None, None, False)],
        "": [(None, None, None, None)],
    }
    rows = spark.createDataFrame([(t, "clash") for t in [*wanted, None]], "text string, start_x string").withColumn("ref", F.lit("2026-09-17 09:00:00").cast("timestamp_ntz"))
    found: dict = {}
    for r in occurrences_df(rows, "ref", dates.named_days(spark, 2020, 2030)).orderBy("clause", "seq").collect():
        found.setdefault(r["text"], []).append((r["start"], r["end"], r["open"], r["all_day"]))
    assert found.pop(None) == [(None, None, None, None)]
    assert found == wanted


def test_numbers_spell_and_read_back(spark):
    rows = spark.range(100).withColumn("w", numerals.spell(F.col("id")))
    assert rows.where(numerals.spelled_number(F.col("w")) != F.col("id")).count() == 0


def test_sign_test_against_the_binomial(spark):
    from math import comb

    from kairoframe.operators.evaluation import regressed

    pairs = [(0, 0), (3, 3), (0, 4), (0, 5), (10, 21), (200, 260), (2000, 2100)]
    rows = spark.createDataFrame(pairs, "f int, b int").select("f", "b", regressed(F.col("f"), F.col("b")).alias("r")).collect()
    tail = lambda f, b: sum(comb(f + b, k) for k in range(b, f + b + 1)) / 2 ** (f + b)
    assert all(r["r"] == (r["b"] > r["f"] and tail(r["f"], r["b"]) < 0.05) for r in rows)


def same_as_sql(spark, name):
    """The rows of a query on the smallest tables, held against its SQL."""
    import duckdb

    from kairoframe.plans import catalog

    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("conversations", "benchmark", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = [tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()]
    assert sorted(got) == sorted(db.execute(catalog.SQL[name]).fetchall())
    return got


def test_all_turns_have_offsets(spark):
    assert {r[1] for r in same_as_sql(spark, "token_offsets_all")} == set(range(8))


def test_spans_reach_the_end_of_a_text(spark):
    from kairoframe.plans.catalog import span_counts

    same_as_sql(spark, "span_token_join_all")
    rows = spark.createDataFrame([(1, "word " * 200), (2, ""), (3, None)], "item_id long, text string")
    units = text.units(F.col("text"))
    assert {r["span_start"] for r in span_counts(rows, F.when(units > 0, units - 1)).collect()} == set(range(0, 1000, 100))


def test_every_order_is_classified_and_gaps_occur(spark):
    got = same_as_sql(spark, "zone_classify_all")
    assert {r[1].month for r in got} == set(range(1, 13)) and {r[2] for r in got} == {"gap", "overlap", "exact"}
