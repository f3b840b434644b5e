"""Labelled tokens to expressions, clauses and segments, as array expressions on one row.

Tokens are an array of (start, end, text, kind, label, clause_start, score) in the order of the text, with
`kind` as in `functions.text.kind` and labels by their numbers. A run of tokens that says something is an
expression: it begins at a labelled token, carries on over asides of a few unlabelled ones, and is trimmed
of what only joins. Within it a clause begins at a marked token if the one before has said something, and
neighbours with equal labels form a segment. All of it is index arithmetic over the array: linear in the
tokens, no shuffle. Null token arrays give null, empty ones and those without a labelled token none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairoframe.functions.text import key, let

#: The numbers of the labels that the operators here tell apart.
OUTSIDE, NUMBER, MONTH, DAY, YEAR, JOIN, GLUE = 0, 1, 11, 12, 13, 31, 32
#: Words before a number that loosen it, and words and signs that an expression may contain unlabelled.
APPROXIMATE = ["khoảng", "tầm", "chừng", "độ", "cỡ", "gần"]
FILLER = [
    *APPROXIMATE, "lúc", "vào", "hồi", "nhằm", "là", "của", "và", "rồi", "thì", "ngày", "buổi", "đúng", "vừa", ",", ";", "&", ":", "-", "–", "—", ".", "/",
]
#: Unlabelled tokens in a row that an expression carries on over, and the least sure score.
ASIDE, SURE = 3, 0.5
TOKEN = "struct<start:int,end:int,text:string,kind:int,label:int,clause_start:boolean,score:double>"


def joins(token: Column) -> Column:
    """Does a token say nothing by itself?"""
    return token["label"].isin(OUTSIDE, JOIN, GLUE)


def is_filler(token: Column) -> Column:
    return key(token["text"]).isin(FILLER)


def positions(array: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The positions, from 0, of the elements that meet a condition on element and position."""
    found = F.filter(F.transform(array, lambda x, i: F.when(keep(x, i), i)), lambda i: i.isNotNull())
    return F.coalesce(found, F.expr("cast(array() as array<int>)"))


def pieces(array: Column, begins: Column) -> Column:
    """The array cut before each of these positions, the first of which is where the first piece begins."""
    return F.transform(begins, lambda b, k: F.slice(array, b + 1, F.coalesce(F.get(begins, k + 1), F.size(array)) - b))


def spoken(tokens: Column) -> Column:
    """The tokens without spaces."""
    return F.filter(tokens, lambda t: t["kind"] != 3)


def split_expressions(tokens: Column) -> Column:
    """An array of arrays of tokens: the expressions of a text, in order, without spaces."""

    def ranges(ts: Column, live: Column) -> Column:
        """(first, last) of each run of live positions with short asides."""
        begins = positions(live, lambda x, k: (k == 0) | (x - F.get(live, k - 1) - 1 > ASIDE))
        whole = lambda bs: F.transform(bs, lambda b, k: F.struct(F.get(live, b).alias("first"), F.get(live, F.coalesce(F.get(bs, k + 1), F.size(live)) - 1).alias("last")))
        return let(begins, whole)

    def cue(ts: Column, i: Column, last: Column) -> Column:
        """A loosening word right before a number."""
        loose = key(F.get(ts, i)["text"]).isin(APPROXIMATE) & (i + 1 <= last)
        return loose & (F.get(ts, i + 1)["label"] == NUMBER)

    def trimmed(ts: Column, r: Column) -> Column:
        own = F.sequence(r["first"], r["last"])
        at = lambda i: F.get(ts, i)
        first = F.array_min(F.filter(own, lambda i: ~joins(at(i)) | F.coalesce(cue(ts, i, r["last"]), F.lit(False))))
        last = F.array_max(F.filter(own, lambda i: F.when(at(i)["label"] == GLUE, ~is_filler(at(i))).otherwise(~joins(at(i)))))
        return F.struct(first.alias("first"), last.alias("last"))

    def cut(ts: Column) -> Column:
        labelled = positions(ts, lambda t, i: t["label"] != OUTSIDE)

        def from_first(s: Column) -> Column:
            loosened = F.coalesce((F.get(ts, s)["label"] == NUMBER) & (s > 0) & key(F.get(ts, F.greatest(s - 1, F.lit(0)))["text"]).isin(APPROXIMATE), F.lit(False))
            begin = F.when(loosened, s - 1).otherwise(s)
            live = positions(ts, lambda t, i: (i >= begin) & ((t["label"] != OUTSIDE) | is_filler(t)))
            found = let(live, lambda at: F.transform(ranges(ts, at), lambda r: trimmed(ts, r)))
            sound = F.filter(found, lambda r: r["first"] <= r["last"])
            return F.transform(sound, lambda r: F.slice(ts, r["first"] + 1, r["last"] - r["first"] + 1))

        return F.when(F.size(labelled) > 0, let(F.array_min(labelled), from_first)).otherwise(F.expr(f"cast(array() as array<array<{TOKEN}>>)"))

    return F.when(tokens.isNotNull(), let(spoken(tokens), cut))


def split_clauses(tokens: Column) -> Column:
    """An expression's tokens cut at each marked one before which its clause has said something.

    Whether the clause has is the same as whether the stretch since the mark before has, as a mark that
    doesn't cut has nothing before it.
    """

    def cut(marks: Column) -> Column:
        said = lambda m, k: F.exists(F.slice(tokens, F.get(marks, k - 1) + 1, m - F.get(marks, k - 1)), lambda t: ~joins(t))
        kept = positions(marks, lambda m, k: (k == 0) | said(m, F.greatest(k, F.lit(1))))
        return let(F.transform(kept, lambda k: F.get(marks, k)), lambda begins: pieces(tokens, begins))

    return F.when(F.size(tokens) > 0, let(positions(tokens, lambda t, i: (i == 0) | t["clause_start"]), cut)).otherwise(F.array(tokens))


def phrase(tokens: Column) -> Column:
    """The text of neighbouring tokens as a key, with a space where the source has a gap."""
    words = F.transform(tokens, lambda t, i: F.concat(F.when((i > 0) & (t["start"] > F.get(tokens, i - 1)["end"]), " ").otherwise(""), t["text"]))
    return key(F.array_join(words, ""))


def segments(tokens: Column) -> Column:
    """(role, tokens, text) of each run of tokens with one label; two runs of digits and what only joins stay apart."""

    def begins(ts: Column) -> Column:
        before = lambda i: F.get(ts, i - 1)
        return positions(ts, lambda t, i: (i == 0) | (t["label"] != before(i)["label"]) | ((t["kind"] == 1) & (before(i)["kind"] == 1)) | joins(t))

    shown = lambda p: F.struct(F.get(p, F.lit(0))["label"].alias("role"), p.alias("tokens"), phrase(p).alias("text"))
    return let(spoken(tokens), lambda ts: let(begins(ts), lambda b: F.transform(pieces(ts, b), shown)))


def date_order(tokens: Column, order: str = "DMY") -> Column:
    """The tokens with numeric dates labelled: a year first means month, day; a number over 12 is the day; else `order` (DMY or MDY)."""
    if order not in ("DMY", "MDY"):
        raise ValueError("order must be DMY or MDY")
    at = lambda i: F.when(i >= 0, F.get(tokens, i))
    separates = lambda t: F.coalesce(joins(t) & t["text"].isin("/", ".", "-"), F.lit(False))
    dated = lambda t: F.coalesce(t["label"].isin(MONTH, DAY) & t["text"].rlike("^[0-9]+$"), F.lit(False))

    def pair(i: Column) -> Column:
        """The labels (a, b) of a date whose numbers are at i and i + 2, null where there is none."""
        a, b = at(i), at(i + 2)
        year_first = F.coalesce(at(i - 1)["label"] == YEAR, F.lit(False)) | (separates(at(i - 1)) & F.coalesce(at(i - 2)["label"] == YEAR, F.lit(False)))
        x, y = a["text"].try_cast("int"), b["text"].try_cast("int")
        sound = F.coalesce(x.between(1, 31) & y.between(1, 31) & ~((x > 12) & (y > 12)), F.lit(False))
        day_first = F.when(x > 12, True).when(y > 12, False).otherwise(F.lit(order == "DMY"))
        labels = lambda m, n: F.struct(F.lit(m).alias("a"), F.lit(n).alias("b"))
        found = F.when(year_first, labels(MONTH, DAY)).when(~sound, None).when(day_first, labels(DAY, MONTH)).otherwise(labels(MONTH, DAY))
        return F.when((i >= 0) & dated(a) & dated(b) & separates(at(i + 1)) & ~b["clause_start"], found)

    return F.transform(tokens, lambda t, i: t.withField("label", F.coalesce(pair(i)["a"], pair(i - 2)["b"], t["label"])))


def summary(tokens: Column, source: Column) -> Column:
    """(start, end, text, confidence, ignored, unsure) of an expression: its span, its least score, the unlabelled words in it."""
    first, last = F.get(tokens, F.lit(0)), F.element_at(tokens, -1)
    least = F.array_min(F.transform(F.filter(tokens, lambda t: ~joins(t)), lambda t: t["score"]))
    ignored = F.transform(F.filter(tokens, lambda t: (t["label"] == OUTSIDE) & (t["kind"] != 3) & ~is_filler(t)), lambda t: t["text"])
    unit = F.encode(source, "UTF-16BE")  # spans count UTF-16 units, of two bytes each
    said = F.decode(F.substring(unit, 2 * first["start"] + 1, 2 * (last["end"] - first["start"])), "UTF-16BE")
    return F.struct(
        first["start"].alias("start"), last["end"].alias("end"), said.alias("text"),
        least.alias("confidence"), F.array_join(ignored, " ").alias("ignored"), (least < SURE).alias("unsure"),
    )


def share_recurrence(clauses: Column) -> Column:
    """A rule that just one of several clauses has, given to those beside it that have a time and neither day, shift nor rule.

    Clauses are structs with `recurrence`, `date`, `shift` and `time`, null where they have none.
    """
    ruled = F.filter(clauses, lambda c: c["recurrence"].isNotNull())
    bare = lambda c: c["recurrence"].isNull() & c["date"].isNull() & c["shift"].isNull() & c["time"].isNotNull()
    given = lambda r: F.transform(clauses, lambda c: F.when(bare(c), c.withField("recurrence", F.get(r, F.lit(0))["recurrence"])).otherwise(c))
    return let(ruled, lambda r: F.when((F.size(r) == 1) & (F.size(clauses) > 1), given(r)).otherwise(clauses))
