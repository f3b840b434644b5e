"""Spans held against tokens by one sweep over the places of a text.

Beginnings of tokens and both ends of spans are put in order by text and bucket of places; what was last begun
goes on from bucket to bucket, so no pair of a token and a span is formed and a long text isn't one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN_ENDS, SPAN_BEGINS, TOKEN = 0, 1, 2


def swept(tokens: DataFrame, spans: DataFrame, by: list[str], bucket: int = 16_384, partitions: int | None = None) -> DataFrame:
    """(by, what, start, end, span, cut): every token once and every span twice, by its beginning and its end.

    Tokens and spans are `start` and `end` beside the columns `by` that name their text; neither overlap among
    themselves. Where spans do, a token is held against the last that began, of these the longest. `span` is the
    (start, end) that a token lies in, null if it lies in none whole; `cut` says of an end of a span that it falls inside a
    token. Rows with a null place or an end before their start are left out. `partitions` is how many tasks they are swept
    in, by default as many as a shuffle has; a task sorts all of its rows, so over large tables it should grow with them.
    """
    place = lambda df: df.where("start <= end").select(F.struct(*by).alias("_key"), F.col("start").cast("long"), F.col("end").cast("long"))
    t, s = place(tokens), place(spans)
    both = s.select("_key", F.explode(F.array(F.lit(SPAN_ENDS), F.lit(SPAN_BEGINS))).alias("what"), "start", "end").unionByName(t.withColumn("what", F.lit(TOKEN)))
    at = F.when(F.col("what") == SPAN_ENDS, F.col("end")).otherwise(F.col("start"))
    both = both.withColumn("_b", F.floor(at / bucket)).where(F.col("_b").isNotNull() & F.col("_key").isNotNull()).repartition(*([partitions] if partitions else []), "_key", "_b")  # crosses the network once: what is carried and what is swept read the same columns
    span, token = F.when(F.col("what") == SPAN_BEGINS, F.struct("start", "end")), F.when(F.col("what") == TOKEN, F.struct("start", "end"))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("_key", "_b").agg(F.max(span).alias("_s0"), F.max(token).alias("_t0"))  # structs order by start, then end
    ends = ends.select("_key", "_b", *[F.last(c, True).over(before).alias(c) for c in ("_s0", "_t0")])
    w = Window.partitionBy("_key", "_b").orderBy("_at", "what", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.join(ends.hint("merge"), ["_key", "_b"]).withColumn("_at", at)
    rows = rows.select(F.col("_key.*"), "_at", "what", "start", "end", F.coalesce(F.last(span, True).over(w), "_s0").alias("_s"), F.coalesce(F.last(token, True).over(w), "_t0").alias("_t"))
    held = F.when((F.col("what") == TOKEN) & (F.col("end") <= F.col("_s.end")) & (F.col("start") < F.col("_s.end")), F.col("_s"))
    inside = F.coalesce((F.col("_t.start") < F.col("_at")) & (F.col("_t.end") > F.col("_at")), F.lit(False))
    return rows.select(*by, "what", "start", "end", held.alias("span"), ((F.col("what") != TOKEN) & inside).alias("cut"))


def tokens_in(sweep: DataFrame) -> DataFrame:
    """The tokens of a sweep with the span each lies in; `aligned` is false for those that lie in none."""
    return sweep.where(F.col("what") == TOKEN).drop("what", "cut").withColumn("aligned", F.col("span").isNotNull())


def spans_held(sweep: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end, tokens, cut_start, cut_end, aligned) for each distinct span: how many tokens it holds, which of its ends
    cut one; aligned if it holds some and cuts none. Tokens in no span are counted nowhere."""
    rows = sweep.where((F.col("what") != TOKEN) | F.col("span").isNotNull())
    token = F.col("what") == TOKEN
    own = {c: F.when(token, F.col("span")[c]).otherwise(F.col(c)).alias(c) for c in ("start", "end")}
    rows = rows.select(*by, own["start"], own["end"], "what", "cut")
    flag = lambda what: F.max((F.col("what") == what) & F.col("cut"))
    out = rows.groupBy(*by, "start", "end").agg(F.count_if(F.col("what") == TOKEN).alias("tokens"), flag(SPAN_BEGINS).alias("cut_start"), flag(SPAN_ENDS).alias("cut_end"))
    return out.withColumn("aligned", (F.col("tokens") > 0) & ~F.col("cut_start") & ~F.col("cut_end"))
