"""What a tagger reads of each token: ranges, flags, classes of letters and signs, hashes, all packed, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, TONES, fnv, kind, length_bucket

#: The upper ends of the number buckets; larger numbers have bucket 13, a leading zero 14, no number 15.
NUMBER_ENDS = [0, 1, 2, 9, 12, 23, 24, 31, 59, 99, 999, 1899, 2099]
#: What a token glued to a number says about clocks and ordinals.
SUFFIXES = ["h", "g", "p", "st", "nd", "rd", "th"]
#: The bits of the flags, in order.
FLAGS = ["upper", "all_upper", "digit", "first", "last", "after_space", "before_space", "suffix_of_number"]
#: Letters with classes of their own after a to z, signs by their classes after the digits', signs as neighbours.
EXTENDED = "ăâđêôơư"
SIGNS = ":-/.,(');&+@!?_=<>[]{}\\\"%#*~`"
NEIGHBOURS = [":", "-", "/", ".", ",", "(", "'", ";", "&", "+", "@"]


@lru_cache(None)
def without(marks: str | None) -> tuple[str, str]:
    """Lower-case letters that have such a mark (null: any), and what is left of each without it."""
    found: dict[str, str] = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(point)
        if letter == letter.lower():
            kept = "".join(c for c in unicodedata.normalize("NFD", letter) if not (unicodedata.combining(c) if marks is None else c in marks))
            left = unicodedata.normalize("NFC", kept)
            if left != letter and len(left) == 1:
                found[letter] = left
    return "".join(found), "".join(found.values())


def base_letter(character: Column) -> Column:
    """In lower case and without its tone: "Ế" is "ê", "á" is "a"."""
    return F.translate(F.lower(character), *without(TONES))


def skeleton(word: Column) -> Column:
    """A word without its marks and vowels."""
    return F.regexp_replace(F.translate(F.lower(word), *without(None)), "[aeiouyăâêôơư]", "")


def character_class(character: Column) -> Column:
    """0 to 25 a letter, 26 to 32 one of the extended, 33 to 42 a digit, from 43 a sign, unknown ones as the first."""
    base = base_letter(character)
    letter, more = F.instr(F.lit("abcdefghijklmnopqrstuvwxyz"), base), F.instr(F.lit(EXTENDED), base)
    sign = F.greatest(F.instr(F.lit(SIGNS), character) - 1, F.lit(0))
    return F.when(letter > 0, letter - 1).when(more > 0, more + 25).when(character.rlike("^[0-9]"), F.ascii(character) - 15).otherwise(43 + sign % 21)


def punctuation_class(token: Column) -> Column:
    """0 where a token isn't one sign, else its place among the neighbours' signs from 1, 12 for others; dashes count as hyphens."""
    plain = F.translate(token, "–—", "--")
    place = F.array_position(F.array(*[F.lit(s) for s in NEIGHBOURS]), plain).cast("int")
    return F.when(token.isNull() | ~token.rlike(rf"^[^\p{{L}}0-9{SPACE}]$"), 0).when(place > 0, place).otherwise(12)


def number_bucket(token: Column) -> Column:
    ends = F.array(*[F.lit(float(e)) for e in NUMBER_ENDS])
    bucket = F.aggregate(ends, F.struct(token.try_cast("double").alias("v"), F.lit(0).alias("n")), lambda a, e: a.withField("n", a["n"] + (a["v"] > e).cast("int")), lambda a: a["n"])
    return F.when(kind(token) != 1, 15).when(token.rlike("^0[0-9]"), 14).otherwise(bucket)


def flag_bits(token: Column, before: Column, after: Column) -> Column:
    """The bits of `FLAGS` of a token between its neighbours, null where it has none."""
    upper = token.rlike(r"\p{Lu}")
    beside = lambda t, k: F.coalesce(kind(t) == k, F.lit(False)) & t.isNotNull()
    facts = [
        upper, upper & (token == F.upper(token)), token.rlike("[0-9]"), before.isNull(), after.isNull(), beside(before, 3), beside(after, 3),
        F.lower(token).isin(SUFFIXES) & beside(before, 1),
    ]
    return sum(((f.cast("int") * (1 << b)) for b, f in enumerate(facts)), F.lit(0))


def between(parts: Column) -> Column:
    """(t, before, after) of each token of an array: spaces are tokens too, and the ends have no neighbour."""
    return F.transform(parts, lambda t, i: F.struct(t.alias("t"), F.when(i > 0, F.get(parts, i - 1)).alias("before"), F.get(parts, i + 1).alias("after")))


def flags(parts: Column) -> Column:
    """One number a token with the bits of `FLAGS`."""
    return F.transform(between(parts), lambda x: flag_bits(x["t"], x["before"], x["after"]))


def packed(*fields: tuple[Column, int]) -> Column:
    """Whole numbers side by side in one long, each shifted by its bits."""
    return sum((F.call_function("shiftleft", value.cast("long"), F.lit(bits)) for value, bits in fields), F.lit(0).cast("long"))


def field(value: Column, shift: int, bits: int) -> Column:
    return F.call_function("shiftright", value, F.lit(shift)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def features(token: Column, before: Column, after: Column) -> Column:
    """(identity, context) of a token between its neighbours: what it is by itself, and what its consonants, flags and neighbours are.

    Meant for tokens that are rows, as `between` exploded gives them: plain columns are compiled, lambdas aren't.
    """
    identity = packed(
        (kind(token), 0), (length_bucket(token), 2), (character_class(F.substring(token, 1, 1)), 5), (character_class(F.substring(token, -1, 1)), 11),
        (fnv(F.lower(token)).bitwiseAND(F.lit(255)), 17), (number_bucket(token), 25),
    )
    context = packed((fnv(skeleton(token)).bitwiseAND(F.lit(127)), 0), (flag_bits(token, before, after), 7), (punctuation_class(before), 15), (punctuation_class(after), 19))
    return F.struct(identity.alias("identity"), context.alias("context"))


#: The regions of the embedding table: first row, which number, shift, bits; the flags have one row a bit from `FLAG_ROW`.
REGIONS = [(0, "identity", 0, 2), (4, "identity", 2, 3), (12, "identity", 5, 6), (76, "identity", 11, 6), (140, "identity", 17, 8), (396, "context", 0, 7), (532, "context", 15, 4), (548, "context", 19, 4), (564, "identity", 25, 4)]
FLAG_ROW, ROWS = 524, 580


def feature_rows(token: Column) -> Column:
    """The rows of the embedding table that a token with (identity, context) stands for."""
    own = F.array(*[F.lit(first) + field(token[name], shift, bits) for first, name, shift, bits in REGIONS])
    set_ = [F.when(field(token["context"], 7 + b, 1) == 1, F.lit(FLAG_ROW + b)) for b in range(len(FLAGS))]
    return F.concat(own, F.array_compact(F.array(*set_)))

