"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A document's size is its number of words. Sources, in code point order with null last, weigh `weights`
in turn and share all words by weight; a source's target stops at `most` times its size, and what is
over goes to the others by weight until none is above (water filling, in closed form). Blocks of equal
size are then dealt to sources by highest quotients target / (2 k - 1), and a source's blocks to its
shards the same way with the shards' words as votes, so every shard has an integer quota.

A shard is the documents of a source that a hash of the id puts together, about `SHARD` words laid end
to end in the order of that hash. Its quota is taken as whole rounds of the shard, as many as go in,
and then blocks chosen by systematic sampling from a seeded start: which of them is arithmetic on the
block's number, so a document finds its own words from its place alone and no block is ever a row. The
words of a quota that are no whole block come from the shard's last, short block.

All is DataFrame expressions. The rows that lie in one task are those of a shard (bounded) and one a
source or a source's shard. Lower and upper bounds of each quota come from the divisors total / (seats
-+ half the parties), so at most a few quotients a party are ranked.

Sizes are zero for null texts; empty sources have target zero. A null source is a source of its own.
Rows that share an id and a size are alike and may swap their words; null ids hash as "null". Reruns
agree, as nothing but ids, sources and sizes decides. Other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, plain

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shard; the longest block; the parts of the smallest target that a block is at most.
SHARD, LONGEST, PARTS = 1 << 22, 1_024, 256


def drawn(*parts: Column | str) -> Column:
    """32 bits from the MD5 of the parts joined by bars."""
    joined = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def div(a: Column, b: Column) -> Column:
    """Whole quotient of longs, null for a divisor of zero."""
    return F.when(b > 0, F.floor((a - F.pmod(a, F.when(b > 0, b))) / b)).cast("long")


def apportion(parties: DataFrame, votes: str, seats: str, key: list[str], within: list[str]) -> DataFrame:
    """Append `quota`, the seats of each party (named by `key`) by Sainte-Laguë, among those alike in `within`.

    `seats` is a column with the group's seats; ties go to the party that comes first by `key`.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    total, count = F.sum(votes).over(group), F.sum((F.col(votes) > 0).cast("long")).over(group)
    share = lambda n: F.floor(F.col(votes) * n / F.when(F.col("_total") > 0, F.col("_total")) + 0.5)
    bounds = parties.withColumn("_total", total.cast("double")).withColumn("_count", count)
    low = F.greatest(F.lit(0), share(F.col(seats) - F.col("_count") / 2) - 1)
    bounds = bounds.withColumn("_low", F.coalesce(low, F.lit(0)).cast("long"))
    bounds = bounds.withColumn("_high", F.coalesce(share(F.col(seats) + F.col("_count") / 2) + 1, F.lit(0)).cast("long"))
    bounds = bounds.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    seat = F.explode(F.sequence(F.col("_low") + 1, F.col("_high")))
    offers = bounds.where((F.col(votes) > 0) & (F.col("_high") > F.col("_low"))).select(*key, votes, "_left", seat.alias("_seat"))
    offers = offers.withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") - 1))
    order = group.orderBy(F.desc("_quotient"), *key, "_seat")
    won = offers.withColumn("_place", F.row_number().over(order)).where("_place <= _left").groupBy(*key).agg(F.count("*").alias("_won"))
    out = bounds.join(won, key, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.drop("_total", "_count", "_low", "_high", "_left", "_won")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) with place, weight, total and target appended."""
    everything, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    rows = sizes.withColumn("place", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    before = everything.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    others = F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", (F.col("total") - full) / (F.sum("weight").over(everything) - others))
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything)
    return rows.withColumn("target", F.least((most * F.col("source_size")).cast("double"), level * F.col("weight"))).drop("ratio", "level")


def chosen(x: Column) -> Column:
    """Words that one partial round of the shard takes before its word x."""
    block, blocks, of, start = F.col("block"), F.col("blocks"), F.col("picked"), F.col("start")
    j = div(x, block)
    upto = lambda k: div(k * of + start, blocks)
    inside = upto(j) * block + (upto(j + 1) - upto(j)) * (x - j * block)
    return F.when(j < blocks, inside).otherwise(of * block + F.least(F.col("short"), x - blocks * block))


def placed(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """Every document with its place in its shard and how the shard is taken."""
    rows = plain(docs, "doc_id", "source", "text").withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    rows = materialise(rows.select("doc_id", F.col("source").cast("string").alias("source"), "size", drawn(seed, F.col("doc_id")).alias("drawn")), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy(F.lit(0)))
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(LONGEST), F.coalesce(F.floor(least / PARTS), F.lit(1)))).cast("long"))
    sources = sources.withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long")).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD)).cast("long"))
    sources = materialise(apportion(sources, "target", "seats", ["place"], []).drop("weight", "total", "seats"), "sources")
    rows = rows.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("shard", F.pmod("drawn", "shards"))
    shards = rows.groupBy("place", "shard").agg(F.sum("size").alias("words"), F.first("block").alias("block"), F.first("quota").alias("source_quota"))
    shards = apportion(shards, "words", "source_quota", ["place", "shard"], ["place"])
    wanted = F.col("quota") * F.col("block")
    shards = shards.withColumn("rounds", F.coalesce(F.least(F.lit(most), div(wanted, F.col("words"))), F.lit(0)).cast("long"))
    shards = shards.withColumn("rest", F.when(F.col("rounds") < most, wanted - F.col("rounds") * F.col("words")).otherwise(0))
    shards = shards.withColumn("blocks", div(F.col("words"), F.col("block"))).withColumn("picked", F.least(F.col("blocks"), div(F.col("rest"), F.col("block"))))
    shards = shards.withColumn("short", F.least(F.col("words") - F.col("blocks") * F.col("block"), F.col("rest") - F.col("picked") * F.col("block")))
    shards = shards.withColumn("start", F.coalesce(F.pmod(drawn(seed, F.col("place"), F.col("shard")), F.when(F.col("blocks") > 0, F.col("blocks"))), F.lit(0)))
    shards = materialise(shards.select("place", "shard", "rounds", "blocks", "picked", "short", "start"), "quotas")
    rows = rows.join(shards, ["place", "shard"])
    along = Window.partitionBy("place", "shard").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("at", F.sum("size").over(along) - F.col("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", spans: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of (doc_id, source, text).

    With `spans` also which words are taken, as an array of (begin, stop, times) counted in words of the document.
    """
    rows = placed(docs, weights, most, seed)
    end = F.col("at") + F.col("size")
    rows = rows.withColumn("taken", (F.col("rounds") * F.col("size") + chosen(end) - chosen(F.col("at"))).cast("long"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    if not spans:
        return rows.select(*out)
    block, blocks = F.col("block"), F.col("blocks")
    numbers = F.when(F.col("size") > 0, F.sequence(div(F.col("at"), block), div(end - 1, block)))
    inside = lambda j: div((j + 1) * F.col("picked") + F.col("start"), blocks) > div(j * F.col("picked") + F.col("start"), blocks)
    stop = lambda j: F.when(j < blocks, (j + 1) * block).otherwise(blocks * block + F.col("short"))
    span = lambda a, b, n: F.struct(a.cast("long").alias("begin"), b.cast("long").alias("stop"), n.cast("long").alias("times"))
    taken = F.filter(numbers, lambda j: F.when(j < blocks, inside(j)).otherwise(F.col("short") > j * block - blocks * block))
    taken = F.transform(taken, lambda j: span(F.greatest(j * block, F.col("at")) - F.col("at"), F.least(stop(j), end) - F.col("at"), F.lit(1)))
    taken = F.filter(F.coalesce(taken, F.array().cast("array<struct<begin:bigint,stop:bigint,times:bigint>>")), lambda s: s["stop"] > s["begin"])
    whole = F.when(F.col("rounds") > 0, F.array(span(F.lit(0), F.col("size"), F.col("rounds")))).otherwise(F.array().cast("array<struct<begin:bigint,stop:bigint,times:bigint>>"))
    return rows.select(*out, F.when(F.col("size") > 0, F.concat(whole, taken)).otherwise(F.array().cast("array<struct<begin:bigint,stop:bigint,times:bigint>>")).alias("spans"))


def texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: (doc_id, source, begin, piece), the words of each span joined by spaces, as often as it is taken."""
    taken = mix(docs, spans=True, **options).where("taken > 0").select("doc_id", "source", F.explode("spans").alias("span"))
    taken = taken.select("doc_id", "source", "span", F.explode(F.sequence(F.lit(1), F.col("span.times"))).alias("copy"))
    words = plain(docs, "doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    part = F.slice("words", (F.col("span.begin") + 1).cast("int"), (F.col("span.stop") - F.col("span.begin")).cast("int"))
    return taken.join(words, "doc_id").select("doc_id", "source", F.col("span.begin").alias("begin"), F.array_join(part, " ").alias("piece"))
