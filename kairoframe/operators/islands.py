"""Gaps and islands, hopping windows over positions, interval joins and metrics over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, by: list[str], bucket: str, first_is_new, number: str, last: dict[str, Column]) -> DataFrame:
    """Carry a number on from bucket to bucket of a key.

    `df` has `number` within each bucket, counted as if each began anew. A bucket is one row where they are
    put in order; `first_is_new` says from what the bucket before ended with whether its first row is one.
    """
    ends = df.groupBy(*by, bucket).agg(F.max(number).alias("_n"), *[c.alias(n) for n, c in last.items()])
    w = Window.partitionBy(*by).orderBy(bucket)
    ends = ends.withColumn("_joined", F.coalesce((~first_is_new(w)).cast("int"), F.lit(0)))
    before = F.coalesce(F.sum(F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("_joined").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_before", before).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, bucket])], "_before")
    same = [df[c].eqNullSafe(ends[f"_k{i}"]) for i, c in enumerate([*by, bucket])]
    return df.join(ends, same).withColumn(number, F.col(number) + F.col("_before")).drop("_before", *[f"_k{i}" for i in range(len(by) + 1)])


def runs(df: DataFrame, by: list[str], order: list[str], value: str, bucket: Column) -> DataFrame:
    """Append `run`: the number of each stretch of equal values, from 1, within `by`.

    `bucket` must not fall where the order rises; a key's rows are ordered in one task a bucket only.
    """
    df = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(*by, "_bucket").orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    out = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    last = {"_first": F.min_by(F.struct(value), place), "_last": F.max_by(F.struct(value), place)}
    begins = lambda w: F.lag("_last").over(w).isNull() | ~F.col(f"_first.{value}").eqNullSafe(F.lag(f"_last.{value}").over(w))
    return carried(out, by, "_bucket", begins, "run", last).drop("_new", "_bucket")


def sessions(df: DataFrame, by: list[str], at: Column, gap: int, tie: str, width: int = 86_400) -> DataFrame:
    """Append `session`, from 1: a new one begins where more than `gap` lies between neighbours.

    A key's rows are ordered in one task for each `width` of time only.
    """
    df = df.withColumn("_at", at).withColumn("_bucket", F.floor(at / width))
    w = Window.partitionBy(*by, "_bucket").orderBy("_at", tie)
    new = F.coalesce((F.col("_at") - F.lag("_at").over(w) > gap).cast("int"), F.lit(1))
    out = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = {"_first": F.min("_at"), "_last": F.max("_at")}
    begins = lambda w: F.lag("_last").over(w).isNull() | (F.col("_first") - F.lag("_last").over(w) > gap)
    return carried(out, by, "_bucket", begins, "session", last).drop("_new", "_bucket", "_at")


def hopping(count: Column, keep: int = 96, context: int = 16) -> Column:
    """Windows over 0..count-1: each keeps `keep` positions and sees `context` more on either side."""
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(keep))
    return F.transform(
        F.when(count > 0, starts).otherwise(F.expr("cast(array() as array<int>)")),
        lambda s: F.struct(s.alias("keep_start"), F.least(s + keep, count).alias("keep_end"), F.greatest(s - context, F.lit(0)).alias("see_start"), F.least(s + keep + context, count).alias("see_end")),
    )


def length_batch(tokens: Column, ends: tuple[int, ...] = (32, 64, 128)) -> Column:
    """The bucket of a text's length that it is batched in, by the bucket's end; null beyond the last."""
    out = F.lit(None).cast("int")
    for end in sorted(ends, reverse=True):
        out = F.when(tokens <= end, end).otherwise(out)
    return out


def slices(tokens: Column, flag_of: str = "context", first: int = 10, last: int = 11) -> Column:
    """The tokens that each hopping window sees, with the bits for the first and the last of a text as they are in the window.

    Tokens are structs with the field `flag_of`, a long whose bits `first` and `last` say so.
    """
    clear = ~((1 << first) | (1 << last))

    def seen(w: Column) -> Column:
        n = w["see_end"] - w["see_start"]
        bits = lambda i: F.when(i == 0, 1 << first).otherwise(0) + F.when(i == n - 1, 1 << last).otherwise(0)
        own = lambda t, i: t.withField(flag_of, t[flag_of].bitwiseAND(F.lit(clear)).bitwiseOR(bits(i).cast("long")))
        return F.struct(w["keep_start"].alias("keep_start"), w["keep_end"].alias("keep_end"), F.transform(F.slice(tokens, w["see_start"] + 1, n), own).alias("tokens"))

    return F.transform(hopping(F.size(tokens)), seen)


def within(tokens: DataFrame, spans: DataFrame, by: str, bucket: int = 256) -> DataFrame:
    """Tokens [start, end) inside spans [span_start, span_end): an interval join by buckets of positions."""
    t = tokens.withColumn("_b", F.floor(F.col("start") / bucket))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("span_start") / bucket), F.floor(F.col("span_end") / bucket))))
    return t.join(s, [by, "_b"]).where("start >= span_start and end <= span_end").drop("_b")


def scores(df: DataFrame, truth: Column, guess: Column, by: list[Column]) -> DataFrame:
    """Counts, precision, recall and F1 of a yes/no guess."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = df.groupBy(*by).agg(n(truth & guess).alias("tp"), n(~truth & guess).alias("fp"), n(truth & ~guess).alias("fn"), F.count("*").alias("n"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def stride(df: DataFrame, order: str, step: int, rows: int = 1_000_000) -> DataFrame:
    """Every step-th row in the order of a unique whole-number column, the first included.

    Ranks come from counts of ranges of the column, so no task orders all rows: there are as many ranges
    as it takes for about `rows` rows each, cut at quantiles, however the values are spread.
    """
    ranges = max(2, df.count() // rows + 1)
    ends = sorted(set(df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 100 * ranges)).head()[0] or []))
    at = F.lit(0)
    if ends:
        at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: F.col(order) > e))
    cut = df.withColumn("_b", at)
    before = cut.groupBy("_b").count().select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_before"))  # a row a range
    ranked = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order))).join(before, "_b")
    return ranked.where((F.col("_before") + F.col("_r") - 1) % step == 0).drop("_b", "_r", "_before")
