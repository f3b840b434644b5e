"""Labels of real text, written out by hand."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from kairoframe.functions import labels
from kairoframe.operators.expressions import split_clauses, split_expressions
from kairoframe.plans.texts import texts_df

#: Texts, and the labels of their words in order; a bar begins a clause.
SAID = {
    "hẹn lúc 7h30 tối mai": "O O HOUR GLUE MINUTE MERIDIEM REL_DAY",
    "thứ ba tuần sau nữa": "WEEKDAY WEEKDAY UNIT DEICTIC DEICTIC",
    "ngày 4 tháng năm năm 2031": "GLUE DOM GLUE MONTH GLUE YEAR",
    "từ mùng 3 đến mùng 6": "RANGE_START LUNAR DOM RANGE_END LUNAR DOM",
    "mỗi thứ tư từ 9h đến 11h trừ cuối tuần": "RECUR WEEKDAY WEEKDAY RANGE_START HOUR GLUE RANGE_END HOUR GLUE EXCEPT DAYGROUP DAYGROUP",
    "họp 45 phút nữa": "O NUM UNIT DIR_AFTER",
    "hai mươi hai ngày trước": "NUM NUM NUM UNIT DIR_BEFORE",
    "thứ năm 8h và thứ sáu 9h": "WEEKDAY WEEKDAY HOUR GLUE JOIN |WEEKDAY WEEKDAY HOUR GLUE",
    "4 lần một tháng": "NUM TIMES RECUR UNIT",
    "rằm tháng chạp": "LUNAR GLUE MONTH",
    "2028-02-29": "YEAR GLUE MONTH GLUE DOM",
    "kéo dài 3 tuần": "DUR DUR NUM UNIT",
    "nghỉ lễ Giáng sinh": "O GLUE HOLIDAY HOLIDAY",
    "cuối tháng này lúc 6 giờ kém 10": "EDGE UNIT DEICTIC O HOUR GLUE CLOCK_OFFSET MINUTE",
}
#: Words of time that say nothing about it here.
SILENT = [
    "", " ", "ba người bạn", "năm cái ghế", "chiều dài con đường", "tối đa bốn món", "sáng suốt", "qua sông", "nhà bên kia suối", "đường 2/9", "phòng 12", "tỉ số 4-2", "sau nhà", "mai vàng", "lần thứ hai", "tư nhân", "3 cân", "90%",
    "hết tiền rồi", "đầu bếp", "cuối sách", "the cat sat", "mỗi người", "một nửa bánh",
]


def test_labels_by_hand(spark):
    rows = labels.label_df(spark.createDataFrame([(t,) for t in SAID], "t string"), "t").collect()
    for r in rows:
        words = [t for t in r["tokens"] if t["kind"] != 3]
        assert " ".join(("|" if t["clause_start"] else "") + labels.LABELS[t["label"]] for t in words) == SAID[r["t"]], r["t"]
        assert "".join(t["text"] for t in r["tokens"]) == r["t"]


def test_what_says_nothing_has_no_label(spark):
    docs = spark.createDataFrame([(i, t, "2026-09-17 09:00:00") for i, t in enumerate([*SILENT, None])], "id int, t string, ref string").withColumn("ref", F.col("ref").cast("timestamp_ntz"))
    for r in labels.label_df(docs, "t").collect():
        assert r["tokens"] is None if r["t"] is None else not any(t["label"] for t in r["tokens"]), r["t"]
    assert {r["diagnostic"] for r in texts_df(docs, "id", "ref", "t").collect()} == {"no-expression"}


def test_labels_are_cut_to_expressions_and_clauses(spark):
    text = "nhớ họp thứ năm 8h và thứ sáu 9h nhé, còn việc kia thì để sau này bàn tiếp, ngày mai gọi"
    rows = labels.label_df(spark.createDataFrame([(text, 1)], "t string, _cut int"), "t", "own")
    assert rows.columns == ["t", "_cut", "own"]
    found = rows.select(F.explode(split_expressions(F.col("own"))).alias("e")).select(F.transform(split_clauses(F.col("e")), lambda c: F.array_join(F.transform(c, lambda t: t["text"]), " ")).alias("c")).collect()
    assert [r["c"] for r in found] == [["thứ năm 8 h và", "thứ sáu 9 h"], ["ngày mai"]]


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_spans_point_into_the_text_as_given(spark, form):
    text = unicodedata.normalize(form, "🎉 tối thứ bảy ở Huế, 2 giờ nữa về")
    rows = spark.createDataFrame([(1, text, "2026-09-17 09:00:00")], "id int, text string, ref string").withColumn("ref", F.col("ref").cast("timestamp_ntz"))
    got = sorted((r["span_start"], r["span_end"], r["said"]) for r in texts_df(rows, "id", "ref").collect())
    cut = lambda a, b: text.encode("utf-16-le")[2 * a : 2 * b].decode("utf-16-le")
    assert [unicodedata.normalize("NFC", cut(a, b)) for a, b, _ in got] == ["tối thứ bảy", "2 giờ nữa"] and all(cut(a, b) == said for a, b, said in got)
