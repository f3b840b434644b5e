"""Specifications, generated phrases, spans and orders of numeric dates."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kairoframe.functions import labels, spans
from kairoframe.operators import dates, schedule
from kairoframe.plans import generate
from kairoframe.plans.parse import parse_df
from kairoframe.plans.phrases import occurrences_df
from kairoframe.plans.texts import texts_df

REF = "2026-09-17 09:00:00"  # a Thursday


POLICIES = ("week_start", "bare", "following")
CASES = [
    (dict(), [("2026-09-17", None)]),
    (dict(kind="now"), [("2026-09-17 09:00:00", None)]),
    (dict(kind="weekday", days=[0, 3]), [("2026-09-21", None), ("2026-09-17", None)]),
    (dict(kind="weekday", days=[0], modifier="next"), [("2026-09-21", None)]),
    (dict(kind="weekday", days=[0], modifier="next", distance=2), [("2026-09-28", None)]),
    (dict(kind="weekday", days=[6], modifier="this", week_start="SU"), [("2026-09-13", None)]),
    (dict(kind="weekdayRange", weekday=4, until_weekday=0), [("2026-09-18", "2026-09-22")]),
    (dict(kind="dayGroup", group="weekend"), [("2026-09-19", None), ("2026-09-20", None)]),
    (dict(kind="dayGroup", group="weekend", modifier="next"), [("2026-09-26", None), ("2026-09-27", None)]),
    (dict(kind="dayGroup", group="weekend", modifier="next", following="immediate"), [("2026-09-19", None), ("2026-09-20", None)]),
    (dict(kind="calendar", day=10), [("2026-10-10", None)]),
    (dict(kind="calendar", month=2, day=29), []),
    (dict(kind="calendar", year=2026), [("2026-09-01", None)]),
    (dict(kind="calendarPeriod", month=3), [("2027-03-01", "2027-04-01")]),
    (dict(kind="calendarPeriod", month=2, year=2027, week=4), [("2027-02-22", "2027-03-01")]),
    (dict(kind="calendarPeriod", month=2, year=2027, week=5), []),
    (dict(kind="calendarPeriod", month=9, modifier="last"), [("2025-09-01", "2025-10-01")]),
    (dict(kind="relativeUnit", unit="week", modifier="next"), [("2026-09-21", "2026-09-28")]),
    (dict(kind="relativeUnit", unit="month", modifier="this", edge="end"), [("2026-09-30", None)]),
    (dict(kind="ordinalWeekday", ordinal=-1, weekday=4, unit="month", modifier="next"), [("2026-10-30", None)]),
    (dict(kind="ordinalWeekday", ordinal=5, weekday=4, month=9), []),
    (dict(kind="calendarRange", day=16, to_day=20), [("2026-09-16", "2026-09-21")]),
    (dict(kind="calendarRange", month=11, day=20, to_month=1, to_day=5), [("2026-11-20", "2027-01-06")]),
    (dict(kind="calendarRange", month=3, day=20, to_month=3, to_day=25), [("2027-03-20", "2027-03-26")]),
    (dict(kind="calendarRange", day=20, to_day=16), []),
]


def test_specifications(spark):
    """All cases of one policy in one plan."""
    short = lambda t: t and (t.date().isoformat() if t.time() == datetime.min.time() else t.isoformat(" "))
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    by: dict = {}
    for fields, periods in CASES:
        policy = tuple(sorted((k, v) for k, v in fields.items() if k in POLICIES))
        by.setdefault(policy, []).append(({k: lit(v) for k, v in fields.items() if k not in POLICIES}, periods))
    for policy, cases in by.items():
        rows = spark.range(1).select(F.posexplode(F.array(*[schedule.spec(**fields) for fields, _ in cases])).alias("i", "s"))
        got = rows.select("i", schedule.resolve_dates(F.col("s"), F.lit(REF), **dict(policy))).collect()
        assert {r[0]: [(short(p["start"]), short(p["end"])) for p in r[1]] for r in got} == {i: periods for i, (_, periods) in enumerate(cases)}


def test_named_specifications_and_unknown_fields(spark):
    named = dates.named_days(spark, 2025, 2028).where("day_key = 'mid-autumn'")
    s = schedule.spec(kind=F.lit("holiday"))
    assert named.select(schedule.resolve_dates(s, F.lit(REF), F.col("days"))).head()[0][0]["start"] == datetime(2026, 9, 25)
    with pytest.raises(ValueError):
        schedule.spec(kinds=F.lit("x"))


def test_generated_phrases_in_sentences_are_understood(spark, tmp_path):
    for name, frames in (("frames", generate.FRAMES), ("reserved", generate.RESERVED)):
        generate.framed(generate.phrases(spark, 900, F.lit(REF)), frames).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        shift = F.col("family") != "shift"  # a shift is read where the text begins with it
        got = parse_df(rows.withColumnRenamed("start", "meant"), "ref").where(shift)
        assert got.where(~F.col("start").eqNullSafe(F.col("meant"))).count() == 0
    again = generate.phrases(spark, 60, F.lit(REF)).collect()
    assert again == generate.phrases(spark, 600, F.lit(REF)).where("id < 60").orderBy("id").collect()


def test_highlights_claim_in_order(spark):
    texts = ["🎉 họp lúc 8h sáng thứ hai tuần sau", "mỗi thứ hai từ 8h đến 10h", "xin chào", "", None, "trong 2 tiếng ngày mai"]
    rows = labels.label_df(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select("t", spans.highlight(F.col("tokens")).alias("s")).collect()
    cut = lambda t, s: t.encode("utf-16-le")[2 * s["start"] : 2 * s["end"]].decode("utf-16-le")
    found = {r["t"]: r["s"] and [(s["kind"], cut(r["t"], s).strip()) for s in r["s"]] for r in rows}
    assert found[texts[0]] == [("time", "lúc 8h sáng"), ("date", "thứ hai tuần sau")]
    assert found[texts[1]] == [("repeat", "mỗi thứ hai"), ("time", "từ 8h đến 10h")]
    assert not found["xin chào"] and not found[""] and found[None] is None
    assert found[texts[5]] == [("duration", "trong 2 tiếng"), ("date", "ngày mai")]


def test_orders_of_numeric_dates(spark):
    named = dates.named_days(spark, 2025, 2028)
    rows = spark.createDataFrame([("3/10/2026",), ("2026-10-03",), ("13/10/2026",), ("10/13/2026",)], "text string").withColumn("ref", F.lit(REF).cast("timestamp_ntz"))
    for order, first in (("DMY", date(2026, 10, 3)), ("MDY", date(2026, 3, 10))):
        got = {r["text"]: r["start"] and r["start"].date() for r in occurrences_df(rows, "ref", named, order=order).collect()}
        assert got == {"3/10/2026": first, "2026-10-03": date(2026, 10, 3), "13/10/2026": date(2026, 10, 13), "10/13/2026": date(2026, 10, 13)}
    with pytest.raises(ValueError):
        occurrences_df(rows, "ref", named, order="YMD")
    with pytest.raises(ValueError):
        occurrences_df(rows, "ref", named, limit=0)


def test_all_expressions_of_a_text_with_their_spans(spark):
    texts = {
        1: "🎉 họp 8h sáng mai, rồi ăn trưa lúc 12h thứ hai tuần sau nhé",
        2: "không có gì",
        3: None,
        4: "",
        5: "gọi lại hai tiếng nữa hoặc ngày mai, đừng 25h",
        6: "hôm nay " * 40,
    }
    rows = spark.createDataFrame(list(texts.items()), "id int, text string").withColumn("ref", F.lit(REF).cast("timestamp_ntz"))
    got: dict = {}
    for r in texts_df(rows, "id", "ref").orderBy("id", "seq").collect():
        got.setdefault(r["id"], []).append(r)
    said = {i: [(r["said"], r["start"], r["diagnostic"]) for r in rs] for i, rs in got.items()}
    assert said[1] == [("8h sáng mai", datetime(2026, 9, 18, 8), None), ("lúc 12h thứ hai tuần sau", datetime(2026, 9, 21, 12), None)]
    assert said[2] == said[3] == said[4] == [(None, None, "no-expression")]
    assert said[5] == [("hai tiếng nữa", datetime(2026, 9, 17, 11), None), ("ngày mai", datetime(2026, 9, 18), None), ("25h", None, "invalid-time")]
    assert len(got[6]) <= 30
    cut = lambda t, r: t.encode("utf-16-le")[2 * r["span_start"] : 2 * r["span_end"]].decode("utf-16-le")
    assert all(cut(texts[i], r).strip() == r["said"] for i in (1, 5) for r in got[i])
