"""Spoken numbers: "hai mươi mốt" is 21, "một trăm hai mươi" 120, "hai nghìn không trăm hai mươi sáu" 2026.

One fold over the words keeps what is summed so far, the group being read and the last scale; words in
an order that forms no number give null. "mươi" wants one to nine before it; "trăm" and "nghìn" without
a number count once; "mốt", "lăm" and "nhăm" come after tens only; "rưỡi" adds a half.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import NUMBERS, SCALES, UNITS, lookup
from .text import key, let


NUMERALS = {k: float(v) for k, v in NUMBERS.items()}


def spelled_number(text: Column, keyed: bool = False) -> Column:
    """The number that a text spells; `keyed` where the text is a key already."""
    return read_key(text) if keyed else let(key(text), read_key)


def read_key(text: Column) -> Column:
    words = F.split(text, " ")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("now"), F.lit(1e18).alias("scale"), F.lit(False).alias("bad"))

    def step(a: Column, w: Column) -> Column:
        scale = lookup(SCALES, w).cast("double")
        value = F.coalesce(lookup(NUMERALS, w), F.when(w.rlike("^[0-9]+$"), w.try_cast("double")))
        now, total = a["now"], a["sum"]
        group = F.coalesce(now, F.lit(1.0))
        tens = (now >= 10) & (F.pmod(now, F.lit(10.0)) == 0)
        state = lambda s, n, c, b: F.struct(s.alias("sum"), n.cast("double").alias("now"), c.alias("scale"), F.coalesce(b, F.lit(True)).alias("bad"))
        keep = a["scale"]
        none = F.lit(None).cast("double")
        return (
            F.when(a["bad"], a)
            .when(scale == 10, state(total, now * 10, scale, ~F.coalesce((now >= 1) & (now <= 9), F.lit(False))))
            .when(scale.isNotNull(), state(F.when(scale > keep, (total + group) * scale).otherwise(total + group * scale), none, scale, F.lit(False)))
            .when(value.isNull(), state(total, now, keep, F.lit(True)))
            .when(w == "mười", state(total, F.lit(10.0), keep, now.isNotNull()))
            .when(w.isin("mốt", "lăm", "nhăm"), state(total, now + value, keep, ~F.coalesce(tens, F.lit(False))))
            .when(w == "rưỡi", state(total, F.coalesce(now, F.lit(0.0)) + 0.5, keep, now.isNull() & (total == 0)))
            .when(w == "nửa", state(total, F.lit(0.5), keep, now.isNotNull()))
            .when(F.coalesce(tens, F.lit(False)) & (value < 10), state(total, now + value, keep, F.lit(False)))
            .when(now.isNull(), state(total, value, keep, F.lit(False)))
            .otherwise(state(total, now, keep, F.lit(True)))
        )

    one = F.coalesce(lookup(NUMERALS, text), F.when(text.rlike("^-?[0-9]+$"), text.try_cast("double")))
    end = F.aggregate(words, start, step)
    return F.when(F.size(words) == 1, one).when(~end["bad"], end["sum"] + F.coalesce(end["now"], F.lit(0.0)))


def spell(value: Column) -> Column:
    """A whole number from 0 to 99 in words, others in digits: 15 "mười lăm", 21 "hai mươi mốt", 24 "hai mươi tư"."""
    words = F.array(*[F.lit(w) for w in "không một hai ba bốn năm sáu bảy tám chín mười".split()])
    tens, ones = F.floor(value / 10).cast("int"), F.pmod(value, F.lit(10)).cast("int")
    after_ten = F.when(ones == 5, "lăm").otherwise(F.get(words, ones))
    after_tens = F.when(ones == 1, "mốt").when(ones == 4, "tư").otherwise(after_ten)
    tail = lambda head, w: F.concat_ws(" ", head, F.when(ones > 0, w))
    spoken = F.when(value <= 10, F.get(words, value.cast("int"))).when(tens == 1, tail(F.lit("mười"), after_ten)).otherwise(tail(F.concat(F.get(words, tens), F.lit(" mươi")), after_tens))
    return F.when(value.between(0, 99), spoken).otherwise(value.cast("string"))


#: What half a day, month or year is; other fractions of calendar units have no reading.
HALVES = {"day": (12, "hour"), "month": (15, "day"), "year": (6, "month")}
CLOCK_UNITS = ["hour", "minute", "second"]
QUARTERS = {"quý": "month"}
_UNIT = "|".join(sorted({*UNITS, *QUARTERS}, key=lambda w: (-len(w), w)))
COMPONENT = rf"([0-9]+[.,][0-9]+|[\p{{L}}0-9]+(?: [\p{{L}}0-9]+)*?) ?({_UNIT})( rưỡi)?(?![\p{{L}}0-9])"


def durations(text: Column) -> Column:
    """The components (amount, unit) of a key that is nothing but quantities: "2 tiếng rưỡi", "1 tiếng 30 phút", "1,5 giờ", "nửa tháng".

    Null where a part has no number above zero, or a fraction that its unit doesn't take.
    """
    group = lambda n: F.regexp_extract_all(text, F.lit(COMPONENT), F.lit(n))
    zipped = F.arrays_zip(group(1).alias("n"), group(2).alias("u"), group(3).alias("h"))

    def one(x: Column) -> Column:
        value = F.coalesce(F.when(x["n"].rlike("^[0-9]+[.,][0-9]+$"), F.replace(x["n"], F.lit(","), F.lit(".")).try_cast("double")), spelled_number(x["n"], True))
        amount = value * F.when(x["u"].isin(list(QUARTERS)), 3).otherwise(1) + F.when(x["h"] != "", 0.5).otherwise(0.0)
        return let(F.struct(amount.alias("amount"), lookup(UNITS | QUARTERS, x["u"]).alias("unit"), (value > 0).alias("some")), sound)

    def sound(d: Column) -> Column:
        made = lambda a, u: F.struct(F.lit(a).cast("double").alias("amount"), F.lit(u).alias("unit"))
        out = F.when(~F.coalesce(d["some"], F.lit(False)), None)
        for unit, (amount, name) in HALVES.items():
            out = out.when((d["unit"] == unit) & (d["amount"] == 0.5), made(amount, name))
        whole = (d["amount"] == F.floor(d["amount"])) | d["unit"].isin(CLOCK_UNITS)
        return out.when(whole, F.struct(d["amount"].alias("amount"), d["unit"].alias("unit")))

    rest = F.trim(F.regexp_replace(text, COMPONENT, ""))
    return let(F.transform(zipped, one), lambda ds: F.when((F.size(ds) > 0) & (rest == "") & ~F.exists(ds, lambda d: d.isNull()), ds))
