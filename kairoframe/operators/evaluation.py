"""Comparing two sets of results: what changed, whether it got worse by more than chance, and agreement by prefix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_agrees(expected: Column, actual: Column) -> Column:
    """Is the expected array the beginning of the actual one?"""
    return F.slice(actual, 1, F.size(expected)) == expected


def signature(labels: Column) -> Column:
    """A digest of the pattern that a row's labels make."""
    return F.sha2(F.array_join(labels.cast("array<string>"), " "), 256)


def disjoint(rows: DataFrame, reserved: DataFrame, by: str) -> DataFrame:
    """The rows whose key no reserved row has."""
    return rows.join(reserved.select(by).distinct(), by, "left_anti")


def threshold_scores(rows: DataFrame, truth: Column, value: Column, thresholds: list[float], by: list[Column]) -> DataFrame:
    """(by..., threshold, tp, fp, fn, f1) of "value above the threshold" as a guess of the truth, for every threshold of the list.

    A row falls into one bin between thresholds and is counted there once; what lies above each threshold is
    summed over the bins, of which a group has one more than there are thresholds. Null values lie above
    none; rows whose truth is null count for neither side. f1 is null where nothing is true or guessed.
    """
    cuts = sorted(thresholds)
    names = [f"_by{i}" for i in range(len(by))]
    bin_ = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.coalesce(c < F.col("_value"), F.lit(False))))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counted = rows.select(*[c.alias(name) for c, name in zip(by, names, strict=True)], truth.alias("_truth"), value.alias("_value"))
    counted = counted.groupBy(*names, bin_.alias("bin")).agg(n(F.col("_truth")).alias("true"), n(~F.col("_truth")).alias("false"))
    bins = counted.groupBy(*names).agg(F.collect_list(F.struct("bin", "true", "false")).alias("bins"))
    cut = bins.select(*names, "bins", F.posexplode(F.array(*[F.lit(c) for c in cuts])).alias("k", "threshold"))
    total = lambda side, keep: F.aggregate(F.filter("bins", keep), F.lit(0).cast("long"), lambda a, b: a + b[side])
    above, below = lambda b: b["bin"] > F.col("k"), lambda b: b["bin"] <= F.col("k")
    out = cut.withColumns({"tp": total("true", above), "fp": total("false", above), "fn": total("true", below)})
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    shown = [F.col(name).alias(rows.select(c).columns[0]) for c, name in zip(by, names, strict=True)]
    return out.select(*shown, "threshold", "tp", "fp", "fn", F.when(whole > 0, 2 * F.col("tp") / whole).alias("f1"))


def best_threshold(scores: DataFrame, threshold: str, score: str, by: str) -> DataFrame:
    """(threshold, least): the threshold whose least score over all groups is largest, of equal ones the smallest."""
    least = scores.groupBy(threshold).agg(F.min(score).alias("least"))
    return least.orderBy(F.desc("least"), threshold).limit(1)


def flips(df: DataFrame, before: Column, after: Column, by: list[Column]) -> DataFrame:
    """(by..., fixed, broke): rows that only one of two yes/no judgements has right."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(*by).agg(n(~before & after).alias("fixed"), n(before & ~after).alias("broke"))


def regressed(fixed: Column, broke: Column, alpha: float = 0.05, support: int = 0) -> Column:
    """The one-sided exact sign test: would so many or more of the rows that moved break by chance with less than alpha?

    Where fewer than `support` rows moved nothing is said to have got worse.
    The binomial tail is summed in logarithms, so that it holds for any number of rows.
    """
    n = fixed + broke
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("tail"))
    step = lambda a, k: F.struct(
        (a["log"] + F.log((n - k + 1) / k)).alias("log"), (a["tail"] + F.when(k >= broke, F.exp(a["log"] + F.log((n - k + 1) / k) - n * math.log(2))).otherwise(0.0)).alias("tail")
    )
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), n.cast("long")), start, step)["tail"]
    return F.when((n == 0) | (n < support) | (broke <= fixed), False).otherwise(tail < alpha)
