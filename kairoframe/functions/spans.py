"""What a preview marks in a text: the neighbours among its labelled tokens that are of one kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairoframe.operators.expressions import positions, spoken

from .labels import LABELS
from .text import key, let

#: Kinds by the labels that decide them; a run has the first kind that any of its tokens has, in this order.
KINDS = {
    "repeat": ["RECUR", "FREQ", "TIMES", "COUNT", "EXCEPT", "BOUND_START", "BOUND_END"],
    "duration": ["DUR"],
    "shift": ["DIR_BEFORE", "DIR_AFTER"],
    "time": ["HOUR", "MINUTE", "SECOND", "MERIDIEM", "TIME_NAMED", "DAYPART", "CLOCK_OFFSET"],
    "date": ["NOW", "REL_DAY", "DEICTIC", "WEEKDAY", "DAYGROUP", "MONTH", "DOM", "YEAR", "HOLIDAY", "EDGE", "LUNAR", "ORD"],
}
#: A word that a time takes with it.
AT = "lúc"
#: Joining words of days.
DAY_WORDS = ["ngày", "tháng", "năm", "lễ"]


def codes(kind: str) -> list[int]:
    return [LABELS.index(name) for name in KINDS[kind]]


def runs(tokens: Column, begins, lasts) -> Column:
    """(start, end) from each token that begins something to the next one that ends it; both conditions take the tokens and a place."""
    return let(spoken(tokens), lambda ts: let(F.struct(positions(ts, lambda t, i: begins(ts, i)).alias("a"), positions(ts, lambda t, i: lasts(ts, i)).alias("b")), lambda p: F.transform(p["a"], lambda a, k: F.struct(
        F.get(ts, a)["start"].alias("start"), F.get(ts, F.get(p["b"], k))["end"].alias("end"), F.slice(ts, a + 1, F.get(p["b"], k) - a + 1).alias("tokens")
    ))))


def at(ts: Column, i: Column) -> Column:
    return F.when(i >= 0, F.get(ts, i))


def says(ts: Column, i: Column) -> Column:
    """Is a token labelled as more than a joining word, or an "at" before such a one?"""
    labelled = lambda t: F.coalesce(~t["label"].isin(0, LABELS.index("JOIN")), F.lit(False))
    return labelled(at(ts, i)) | (F.coalesce(key(at(ts, i)["text"]) == AT, F.lit(False)) & labelled(at(ts, i + 1)))


def neighbours(tokens: Column) -> Column:
    """(start, end, tokens) of the longest rows of labelled tokens with nothing but spaces between them."""
    return runs(tokens, lambda ts, i: says(ts, i) & ~says(ts, i - 1), lambda ts, i: says(ts, i) & ~says(ts, i + 1))


def clocked(ts: Column, i: Column) -> Column:
    """Does a token belong to a clock: by its label, as a joining word inside one, or as what leads to one?"""
    label = lambda j: at(ts, j)["label"]
    clock = lambda j: F.coalesce(label(j).isin(*codes("time")), F.lit(False))
    inside = (label(i) == LABELS.index("GLUE")) & ~key(at(ts, i)["text"]).isin(DAY_WORDS) & clock(i - 1)
    leads = label(i).isin(0, LABELS.index("RANGE_START"), LABELS.index("RANGE_END")) & clock(i + 1)
    return clock(i) | F.coalesce(inside | leads, F.lit(False))


def highlight(tokens: Column) -> Column:
    """The spans (start, end, kind) of labelled tokens (`labels.label_df`), in order of the text.

    Clocks and days side by side are spans of their own, and what repeats or lasts begins one.
    """

    def parted(ts: Column, i: Column) -> Column:
        """Does a span begin here, inside of a row of labelled tokens?"""
        label = lambda j: at(ts, j)["label"]
        begins = label(i).isin(*[LABELS.index(n) for n in ("RECUR", "DUR", "EXCEPT", "RANGE_START")]) & (label(i) != label(i - 1)) & (label(i - 1) != LABELS.index("TIMES"))
        counted = label(i).isin(*codes("date")) & (label(i - 1) == LABELS.index("UNIT")) & (label(i - 2) == LABELS.index("NUM"))
        return F.coalesce(begins | counted, F.lit(False)) | (clocked(ts, i) != clocked(ts, i - 1))

    def kind(ts: Column) -> Column:
        has = lambda name: F.exists(ts, lambda t: t["label"].isin(*codes(name)))
        out = F.lit("date")
        for name in reversed(KINDS):
            out = F.when(has(name), name).otherwise(out)
        return out

    begin = lambda ts, i: says(ts, i) & (~says(ts, i - 1) | parted(ts, i))
    last = lambda ts, i: says(ts, i) & (~says(ts, i + 1) | parted(ts, i + 1))
    found = F.transform(runs(tokens, begin, last), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), kind(r["tokens"]).alias("kind")))
    return F.when(tokens.isNotNull(), found)
