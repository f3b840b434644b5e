"""Tokens of a text as Column expressions: composition, lossless splitting, kinds, offsets, hashes, buckets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the grammar counts it, and the token pattern over it.
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TOKEN = rf"[\p{{L}}_]+(?:['’][\p{{L}}]+)*|[0-9]+|[{SPACE}]+|[^{SPACE}]"
#: The upper ends of the word length buckets; longer words are in the last.
LENGTHS = [1, 2, 3, 4, 6, 8, 12]
#: The combining marks of Vietnamese: grave, acute, tilde, hook above, dot below; circumflex, breve, horn.
TONES = "\u0300\u0301\u0303\u0309\u0323"
MARKS = TONES + "\u0302\u0306\u031b"
#: 32-bit FNV-1a.
FNV_BASIS, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295


def tokens(text: Column) -> Column:
    """The tokens of a text, spaces included; joined again they are the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def kind(token: Column) -> Column:
    """0 word, 1 digits, 2 symbol, 3 space."""
    return F.when(token.rlike(rf"^[{SPACE}]"), 3).when(token.rlike("^[0-9]"), 1).when(token.rlike(r"^[\p{L}_]"), 0).otherwise(2)


def units(text: Column) -> Column:
    """The length in UTF-16 code units, which offsets are counted in."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, chunk: int = 64) -> Column:
    """What comes before each number of an array, summed; in chunks, so that long arrays take no square of their length."""
    zero = F.lit(0).cast("int")
    before = lambda xs: F.slice(F.aggregate(xs, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 1, F.size(xs))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / chunk).cast("int")), lambda i: F.slice(xs, i * chunk + 1, chunk))
    total = lambda c: F.aggregate(c, zero, lambda a, x: a + x)
    joined = lambda cs: let(before(F.transform(cs, total)), lambda at: F.flatten(F.transform(cs, lambda c, i: F.transform(before(c), lambda x: x + F.get(at, i)))))
    return let(numbers, lambda xs: F.when(F.size(xs) > 0, let(cut(xs), joined)).otherwise(xs))


def starts(parts: Column) -> Column:
    """Where each token starts, in UTF-16 units."""
    return running(F.transform(parts, units))


def fnv(text: Column) -> Column:
    """FNV-1a over the UTF-16 units of a text."""
    mix = lambda a, unit: (a.bitwiseXOR(unit) * FNV_PRIME).bitwiseAND(F.lit(MASK))

    def step(a: Column, c: Column) -> Column:
        point = F.ascii(c).cast("long")
        beyond = point - 0x10000  # a pair of surrogates
        return F.when(point < 0x10000, mix(a, point)).otherwise(mix(mix(a, F.lit(0xD800) + (beyond / 1024).cast("long")), F.lit(0xDC00) + beyond % 1024))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_BASIS).cast("long"), step)


@lru_cache(None)
def compositions() -> dict[str, str]:
    """A letter with the marks of Vietnamese after it, in any order, wholly or partly taken apart, and its composed form."""
    out = {}
    for point in [*range(0xC0, 0x1B5), *range(0x1EA0, 0x1EFA)]:
        whole = chr(point)
        base, *marks = unicodedata.normalize("NFD", whole)
        if not set(marks) <= set(MARKS) or not marks:
            continue
        for k in range(len(marks)):
            for order in permutations(marks):
                head = unicodedata.normalize("NFC", base + "".join(order[:k]))
                if len(head) == 1:
                    out[head + "".join(order[k:])] = whole
    return out


def composed(text: Column) -> Column:
    """Letters joined with the combining marks of Vietnamese that follow them; texts without such a mark stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in compositions().items() for x in pair])
    clusters = F.regexp_extract_all(text, F.lit(rf"[^{MARKS}][{MARKS}]+|[^{MARKS}]+?(?=[^{MARKS}][{MARKS}]|\z)|[{MARKS}]+"), F.lit(0))
    made = F.array_join(F.transform(clusters, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(text.rlike(f"[{MARKS}]"), made).otherwise(text)


def sources(text: Column) -> Column:
    """Where each UTF-16 unit of the composed text, and its end, is in the text itself: what a letter and its marks became starts at the last of them."""
    table = F.create_map(*[F.lit(x) for pair in compositions().items() for x in pair])
    clusters = F.regexp_extract_all(text, F.lit(rf"(?s)[^{MARKS}][{MARKS}]*|[{MARKS}]+"), F.lit(0))
    own = lambda c: F.sequence(F.lit(0), units(c) - 1)
    place = lambda c: F.when(F.try_element_at(table, c).isNotNull(), F.array(units(c) - 1)).otherwise(own(c))
    at = lambda cs: let(starts(cs), lambda ss: F.flatten(F.transform(cs, lambda c, i: F.transform(place(c), lambda x: x + F.get(ss, i)))))
    return F.concat(F.when(F.length(text) > 0, let(clusters, at)).otherwise(F.expr("cast(array() as array<int>)")), F.array(units(text)))


def length_bucket(token: Column) -> Column:
    ends = F.array(*[F.lit(e) for e in LENGTHS])
    return F.aggregate(ends, F.struct(units(token).alias("v"), F.lit(0).alias("n")), lambda a, e: a.withField("n", a["n"] + (a["v"] > e).cast("int")), lambda a: a["n"])


def key(text: Column) -> Column:
    """What lexicons are asked by: composed, lower case, single spaces, none around."""
    return F.trim(F.regexp_replace(F.lower(composed(text)), rf"[{SPACE}]+", " "))
