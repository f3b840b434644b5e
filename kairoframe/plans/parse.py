"""Phrases to occurrences: days, weekdays, calendar units, shifts and clock times, on plain columns.

A text is tokenized and brought to its key; patterns over the lexicon find what it names; the date and
the clock resolve against a reference wall clock of the same row. One row in, one row out, no shuffle:
start, end (exclusive, null for a moment), all_day, and a diagnostic where nothing or nothing sound is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.functions import civil
from kairoframe.functions.lexicon import DAY_PARTS, MODIFIERS, RELATIVE_DAYS, UNITS, WEEKDAYS, alternatives, lookup
from kairoframe.functions.numerals import spelled_number
from kairoframe.functions.text import key

EDGE = r"(?<![\p{L}\d])(?:%s)(?![\p{L}\d])"
CLOCK = r"(?<![\p{L}\d])(\d{1,2})\s*(?:giờ|h(?![\p{L}])|:)\s*(\d{1,2}|rưỡi|kém \d{1,2})?"
SHIFT = r"^([\p{L}\d ]+?) (giây|phút|giờ|tiếng|ngày|tuần|tháng|năm) (nữa|sau|trước)(?![\p{L}])"


def found(text: Column, table: dict) -> Column:
    """The first word of a table in a text, null without one."""
    word = F.regexp_extract(text, EDGE % alternatives(table), 0)
    return F.when(word != "", word)


def understand(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append what the text names: rel_day, dow, modifier, unit, amount, shift_unit, hour, minute, part."""
    df = df.withColumn("_key", key(F.col(text_col)))
    text = F.col("_key")
    modifier = lambda lead: lookup(MODIFIERS, F.nullif(F.regexp_extract(text, rf"(?:{lead}) ({alternatives(MODIFIERS)})(?![\p{{L}}])", 1), F.lit("")))
    hour = F.regexp_extract(text, CLOCK, 1)
    minute = F.regexp_extract(text, CLOCK, 2)
    before = F.regexp_extract(minute, r"kém (\d+)", 1).try_cast("int")
    amount = spelled_number(F.regexp_extract(text, SHIFT, 1), keyed=True)
    known = F.regexp_extract(text, SHIFT, 0) != ""
    calendar = r"tuần|tháng|năm"
    return df.withColumns(
        {
            "amount": F.when(known, amount),
            "shift_unit": F.when(known & amount.isNotNull(), lookup(UNITS, F.regexp_extract(text, SHIFT, 2))),
            "backward": F.regexp_extract(text, SHIFT, 3) == "trước",
            "dow": lookup(WEEKDAYS, found(text, WEEKDAYS)),
            "dow_modifier": modifier(rf"(?:{alternatives(WEEKDAYS)})(?: tuần)?"),
            "unit": lookup(UNITS, F.nullif(F.regexp_extract(text, rf"(?<![\p{{L}}])({calendar}) (?:{alternatives(MODIFIERS)})(?![\p{{L}}])", 1), F.lit(""))),
            "unit_modifier": modifier(calendar),
            "rel_day": lookup(RELATIVE_DAYS, found(text, RELATIVE_DAYS)),
            "part": lookup(DAY_PARTS, found(text, DAY_PARTS)),
            "hour": F.when(before.isNotNull(), hour.try_cast("int") - 1).otherwise(hour.try_cast("int")),
            "minute": F.when(hour == "", None).when(minute == "rưỡi", 30).when(before.isNotNull(), 60 - before).otherwise(F.coalesce(minute.try_cast("int"), F.lit(0))),
        }
    )


def resolve(df: DataFrame, reference: str) -> DataFrame:
    """Append start, end, all_day and diagnostic from what `understand` found and the reference wall clock."""
    ref = F.col(reference).cast("timestamp_ntz")
    today = ref.cast("date")
    steps = F.when(F.col("unit_modifier") == "next", 1).when(F.col("unit_modifier") == "last", -1).otherwise(0)
    unit_start = F.lit(None).cast("date")
    unit_end = F.lit(None).cast("date")
    for unit in ("week", "month", "year"):
        base = F.date_trunc(unit, ref)
        unit_start = F.when(F.col("unit") == unit, F.timestamp_add(unit.upper(), steps, base).cast("date")).otherwise(unit_start)
        unit_end = F.when(F.col("unit") == unit, F.timestamp_add(unit.upper(), steps + 1, base).cast("date")).otherwise(unit_end)
    signed = F.when(F.col("backward"), -F.col("amount")).otherwise(F.col("amount")).cast("int")
    moved = F.lit(None).cast("timestamp_ntz")
    for unit in ("second", "minute", "hour", "day", "week", "month", "year"):
        moved = F.when(F.col("shift_unit") == unit, F.timestamp_add(unit.upper(), signed, ref)).otherwise(moved)
    shift = F.col("shift_unit").isNotNull() & (F.col("amount") == F.floor("amount"))
    weekday = civil.weekday_near(today, F.col("dow"), F.col("dow_modifier"))
    day = F.when(F.col("dow").isNotNull(), weekday).when(F.col("unit").isNotNull(), unit_start).when(F.col("rel_day").isNotNull(), F.date_add(today, F.col("rel_day")))
    clock = F.col("hour").isNotNull()
    hour = F.when(F.col("part").isNull(), F.col("hour")).otherwise(civil.fold_hour(F.col("hour"), F.col("part")))
    sound = ~clock | ((hour <= 24) & (F.col("minute") < 60))
    seconds = (F.pmod(hour, F.lit(24)) * 60 + F.col("minute")) * 60
    base = F.coalesce(day, today)
    at = F.timestamp_add("SECOND", seconds.cast("int"), base.cast("timestamp_ntz"))
    at = F.when(day.isNull() & (at < ref), F.timestamp_add("DAY", F.lit(1), at)).otherwise(at)
    starts, ends = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (a, b) in civil.PART_HOURS.items():
        starts = F.when(F.col("part") == name, a).otherwise(starts)
        ends = F.when(F.col("part") == name, b if b > a else b + 24).otherwise(ends)
    part = F.col("part").isNotNull() & ~clock
    span = lambda h: F.timestamp_add("HOUR", h, base.cast("timestamp_ntz"))
    start = F.when(shift, moved).when(clock & sound, at).when(clock, None).when(part, span(starts)).otherwise(day.cast("timestamp_ntz"))
    next_day = F.date_add(day, 1).cast("timestamp_ntz")
    end = F.when(shift | clock, None).when(part, span(ends)).when(F.col("dow").isNull() & F.col("unit").isNotNull(), unit_end.cast("timestamp_ntz")).otherwise(next_day)
    whole = day.isNotNull() & ~shift & ~clock & ~part
    return df.withColumns(
        {"start": start, "end": end, "all_day": whole, "diagnostic": F.when(clock & ~sound & ~shift, "invalid-time").when(start.isNull(), "no-expression")}
    )


def parse_df(df: DataFrame, reference: str, text_col: str = "text") -> DataFrame:
    """Every row of df with start, end, all_day and diagnostic for the first expression of its text."""
    named = understand(df, text_col)
    return resolve(named, reference).select(*df.columns, "start", "end", "all_day", "diagnostic")
