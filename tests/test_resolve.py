"""Texts through labels and clauses to occurrences, written out by hand."""

import pytest

from kairoframe.functions import labels
from kairoframe.operators.compile import compile_df
from kairoframe.plans.resolve import resolve_df

REF = "2026-09-17 09:00:00"  # a Thursday
CASES = {
    "8h tối mai": [("2026-09-18 20:00", None)],
    "lúc 7 giờ sáng": [("2026-09-18 07:00", None)],
    "thứ năm lúc 8 giờ sáng": [("2026-09-24 08:00", None)],
    "thứ hai tuần sau": [("2026-09-21 00:00", None)],
    "từ 10h đến 11h30 sáng mai": [("2026-09-18 10:00", "2026-09-18 11:30")],
    "3 ngày nữa": [("2026-09-20 09:00", None)],
    "2 tiếng 15 phút nữa": [("2026-09-17 11:15", None)],
    "tháng sau": [("2026-10-01 00:00", "2026-11-01 00:00")],
    "từ 29/3 đến 4/4/2031": [("2031-03-29 00:00", "2031-04-05 00:00")],
    "rằm tháng 8": [("2026-09-25 00:00", None)],
    "31/2/2027": None,
    "mỗi thứ tư lúc 9 giờ sáng, 2 lần": [("2026-09-23 09:00", None), ("2026-09-30 09:00", None)],
    "cuối tuần": [("2026-09-19 00:00", None), ("2026-09-20 00:00", None)],
    "trời hôm đó rất đẹp": None,
}


def test_texts_resolve(spark):
    rows = spark.createDataFrame([(k, REF) for k in CASES] + [(None, REF), ("", REF)], "text string, ref string")
    found = resolve_df(compile_df(labels.label_df(rows, "text")), "ref")
    short = lambda t: t and t.isoformat(" ")[:16]
    got = {r.text: r.occurrences and [(short(o.start), short(o.end)) for o in r.occurrences] for r in found.collect()}
    assert got.pop(None) is None and got.pop("") is None
    assert {k: v for k, v in got.items() if v != CASES[k]} == {}


def test_clashing_names_are_an_error(spark):
    rows = spark.createDataFrame([(1, REF)], "code int, ref string")
    with pytest.raises(ValueError):
        resolve_df(rows, "ref")


def test_empty_table(spark):
    rows = spark.createDataFrame([], "text string, ref string")
    assert resolve_df(compile_df(labels.label_df(rows, "text")), "ref").collect() == []
