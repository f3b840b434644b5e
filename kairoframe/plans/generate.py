"""Phrases made by rule, with what they mean: the source of property tests and of load for the parser.

Row i's family and parameters are arithmetic on i, so a corpus of any size is one projection over a range,
the same on every run and cluster. Frames put a phrase into a sentence; negatives are sentences that look
like ones about time and aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoframe.functions import civil
from kairoframe.functions.numerals import spell

#: Families in turn: what row i says is family i mod their number, with parameters from i div it.
FAMILIES = ["relative_day", "weekday", "clock", "shift", "unit", "part"]
DAYS = [("hôm nay", 0), ("ngày mai", 1), ("ngày kia", 2), ("hôm qua", -1), ("hôm kia", -2)]
WEEKDAYS = ["thứ hai", "thứ ba", "thứ tư", "thứ năm", "thứ sáu", "thứ bảy", "chủ nhật"]
STEPS = [("này", "this", 0), ("sau", "next", 1), ("trước", "last", -1)]
UNITS = [("tuần", "week"), ("tháng", "month"), ("năm", "year")]
SHIFTS = [("phút", "MINUTE"), ("tiếng", "HOUR"), ("ngày", "DAY"), ("tuần", "WEEK")]
PARTS = [("sáng", "morning"), ("chiều", "afternoon"), ("tối", "evening")]
#: Sentences around a phrase; the reserved ones are for tests that training must not see.
FRAMES = ["{}", "hẹn gặp bạn {}", "{} nhé", "nhắc tôi gọi điện {}", "cuộc họp là {}"]
RESERVED = ["nhớ uống thuốc {}", "{} chúng ta bắt đầu", "báo cáo nộp {}"]
NEGATIVES = ["xin chào bạn", "cảm ơn rất nhiều", "quyển sách trên bàn", "số điện thoại của tôi", "gia đình vui vẻ"]


def pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(at, F.lit(len(values))).cast("int"))


def phrases(spark: SparkSession, rows: int, reference: Column) -> DataFrame:
    """(id, family, text, start): the phrases, and when each begins at a reference wall clock."""
    ids = spark.range(rows).withColumn("family", pick(FAMILIES, F.col("id"))).withColumn("k", F.floor(F.col("id") / len(FAMILIES)))
    ids = ids.withColumn("ref", reference.cast("timestamp_ntz")).withColumn("today", F.col("ref").cast("date"))
    k, today, ref = F.col("k"), F.col("today"), F.col("ref")
    at = lambda day, hour, minute=0: F.timestamp_add("MINUTE", (hour * 60 + minute).cast("int") if isinstance(hour, Column) else F.lit(hour * 60 + minute), day.cast("timestamp_ntz"))
    step, amount = F.floor(k / 7), F.pmod(k, F.lit(20)) + 1
    hour, part = F.pmod(k, F.lit(10)) + 1, pick([p for _, p in PARTS], F.floor(k / 10))
    clock = civil.fold_hour(hour, part)
    moved = F.lit(None).cast("timestamp_ntz")
    for i, (_, unit) in enumerate(SHIFTS):
        moved = F.when(F.pmod(F.floor(k / 20), F.lit(len(SHIFTS))) == i, F.timestamp_add(unit, amount.cast("int"), ref)).otherwise(moved)
    unit_start = F.lit(None).cast("timestamp_ntz")
    for i, (_, unit) in enumerate(UNITS):
        first = F.date_trunc(unit, today.cast("timestamp_ntz"))
        unit_start = F.when(F.pmod(k, F.lit(3)) == i, F.timestamp_add(unit.upper(), pick([n for *_, n in STEPS], F.floor(k / 3)), first)).otherwise(unit_start)
    begins = F.lit(None).cast("int")
    for name, (start, _) in civil.PART_HOURS.items():
        begins = F.when(pick([p for _, p in PARTS], k) == name, start).otherwise(begins)
    said = {
        "relative_day": (pick([w for w, _ in DAYS], k), F.date_add(today, pick([n for _, n in DAYS], k)).cast("timestamp_ntz")),
        "weekday": (F.concat_ws(" ", pick(WEEKDAYS, k), F.lit("tuần"), pick([w for w, *_ in STEPS], step)), civil.weekday_near(today, F.pmod(k, F.lit(7)).cast("int"), pick([m for _, m, _ in STEPS], step)).cast("timestamp_ntz")),
        "clock": (F.concat_ws(" ", hour.cast("string"), F.lit("giờ"), pick([w for w, _ in PARTS], F.floor(k / 10)), F.lit("mai")), at(F.date_add(today, 1), clock)),
        "shift": (F.concat_ws(" ", spell(amount), pick([w for w, _ in SHIFTS], F.floor(k / 20)), F.lit("nữa")), moved),
        "unit": (F.concat_ws(" ", pick([w for w, _ in UNITS], k), pick([w for w, *_ in STEPS], F.floor(k / 3))), unit_start),
        "part": (F.concat_ws(" ", pick([w for w, _ in PARTS], k), F.lit("mai")), at(F.date_add(today, 1), begins)),
    }
    text, start = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    for name, (words, when) in said.items():
        text, start = F.when(F.col("family") == name, words).otherwise(text), F.when(F.col("family") == name, when).otherwise(start)
    return ids.select("id", "family", text.alias("text"), start.alias("start"), "ref")


def framed(rows: DataFrame, frames: list[str] = FRAMES, negatives: int = 5) -> DataFrame:
    """The phrases in sentences; every `negatives`-th row says nothing about time instead, and begins never."""
    none = F.pmod(F.col("id"), F.lit(negatives)) == negatives - 1
    text = F.format_string("%s%s%s", pick([f.split("{}")[0] for f in frames], F.col("id")), F.col("text"), pick([f.split("{}")[1] for f in frames], F.col("id")))
    return rows.withColumns({"text": F.when(none, pick(NEGATIVES, F.floor(F.col("id") / negatives))).otherwise(text), "start": F.when(~none, F.col("start")), "family": F.when(none, "negative").otherwise(F.col("family"))})
