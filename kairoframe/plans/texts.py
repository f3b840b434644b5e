"""Whole texts to all they say about time: expressions with their spans, each resolved, merged by text.

Tokens are labelled (`functions.labels`); neighbours with a space between them are one expression, a joining
word or anything unlabelled parts them. Every expression is resolved by itself, so one that names nothing sound
leaves the others as they are. Rows come with the place of the expression in the text as it was given and, for
each text, in the order of their beginnings; at most `limit` of them, with whether there were more. Null and
empty texts, and those without a label, give one row with nulls and the diagnostic no-expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.functions.labels import label_df
from kairoframe.functions.spans import neighbours

from .parse import parse_df


def expressions(tokens: Column, text: Column) -> Column:
    """(start, end, said) of each expression of a text with labelled tokens, in UTF-16 units."""
    unit = F.encode(text, "UTF-16BE")
    said = lambda a, b: F.decode(F.substring(unit, 2 * a + 1, 2 * (b - a)), "UTF-16BE")
    return F.transform(neighbours(tokens), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), said(r["start"], r["end"]).alias("said")))


def texts_df(df: DataFrame, key: str, reference: str, text_col: str = "text", limit: int = 30) -> DataFrame:
    """(key, seq, span_start, span_end, said, start, end, all_day, diagnostic, truncated) for each text of df, whose keys are unique."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    rows = label_df(df.select(F.col(key).alias("key"), F.col(reference).alias("ref"), F.col(text_col).alias("text")), "text")
    rows = rows.select("key", "ref", F.explode_outer(expressions(F.col("tokens"), F.col("text"))).alias("e"))
    rows = rows.select("key", "ref", F.col("e.start").alias("span_start"), F.col("e.end").alias("span_end"), F.trim("e.said").alias("said"))
    found = parse_df(rows, "ref", "said")
    order = Window.partitionBy("key").orderBy(F.col("start").asc_nulls_last(), F.col("span_start"))
    found = found.withColumn("seq", F.row_number().over(order)).withColumn("truncated", F.count("*").over(Window.partitionBy("key")) > limit)
    return found.where(F.col("seq") <= limit).select(F.col("key").alias(key), "seq", "span_start", "span_end", "said", "start", "end", "all_day", "diagnostic", "truncated")
