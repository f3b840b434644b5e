"""Wall clocks of rows that name their own zone, by a table of the zones' transitions.

`transitions` finds when the offsets of zones change, with what they are before and after; it is a table of a
few hundred rows a zone. `resolve_walls` meets it by zone and stretch of time: each stretch has the offset at its
beginning and the changes in it, so a row joins one row at most, and gaps and overlaps of any length are exact.
Offsets are looked at four times a day; two changes within six hours that undo each other aren't seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds between two looks at an offset, and of the stretches that walls and transitions meet by.
LOOK, STRETCH = 6 * 3600, 64 * 86_400
#: As many zones as the table is sent to all tasks for: some 1,200 stretches each for 200 years.
FEW = 1_000
CHANGE = "struct<at:bigint,before:bigint,after:bigint>"


def known_zone(zone: Column) -> Column:
    """Is a zone's name one of the zone database, or an offset?"""
    return F.try_reflect(F.lit("java.time.ZoneId"), F.lit("of"), zone).isNotNull()


def offset(second: Column, zone: Column) -> Column:
    """Seconds that a zone's clocks are ahead of UTC at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(second), zone)) - second


def transitions(zones: DataFrame, zone: str, first_year: int, last_year: int) -> DataFrame:
    """(zone, at, before, after): each instant from which on a zone's offset is another, in seconds.

    Only names that `known_zone` takes; null, unknown and repeated ones give nothing further. From the beginning of
    the first year to the end of the last.
    """
    if not 1 <= first_year <= last_year <= 9998:
        raise ValueError("years from 1 to 9998")
    named = zones.select(F.col(zone).alias("zone")).distinct().where(known_zone(F.col("zone")))
    begin, end = F.unix_seconds(F.lit(f"{first_year:04}-01-01").cast("timestamp")), F.unix_seconds(F.lit(f"{last_year + 1:04}-01-01").cast("timestamp"))
    z = F.col("zone")
    looks = named.select("zone", F.explode(F.sequence(begin, end - LOOK, F.lit(LOOK))).alias("_low")).withColumn("before", offset(F.col("_low"), z))
    looks = looks.withColumn("after", offset(F.col("_low") + LOOK, z)).where("before <> after")
    half = lambda s: ((s["low"] + s["high"]) / 2).cast("long")
    narrower = lambda s, _: F.when(s["high"] - s["low"] <= 1, s).when(offset(half(s), z) == F.col("before"), F.struct(half(s).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), half(s).alias("high")))
    around = F.struct(F.col("_low").alias("low"), (F.col("_low") + LOOK).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(LOOK.bit_length())), around, narrower)
    return looks.select("zone", found["high"].alias("at"), "before", "after")


def stretches(zones: DataFrame, zone: str, first_year: int, last_year: int) -> DataFrame:
    """(zone, stretch, begins, changes): by stretch of local time the offset it begins with and the changes that touch it, in order."""
    changed = transitions(zones, zone, first_year, last_year)
    begin, end = F.unix_seconds(F.lit(f"{first_year:04}-01-01").cast("timestamp")), F.unix_seconds(F.lit(f"{last_year + 1:04}-01-01").cast("timestamp"))
    held = changed.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("at", "before", "after"))).alias("_all"))
    named = zones.select(F.col(zone).alias("zone")).distinct().where(known_zone(F.col("zone"))).join(held, "zone", "left")
    named = named.withColumn("_all", F.coalesce("_all", F.expr(f"cast(array() as array<{CHANGE}>)"))).withColumn("_first", offset(begin, F.col("zone")))
    rows = named.select("zone", "_all", "_first", F.explode(F.sequence(F.floor(begin / STRETCH), F.floor((end - 1) / STRETCH))).alias("stretch"))
    over = lambda c: c["at"] + F.greatest(c["before"], c["after"])
    start = F.col("stretch") * STRETCH
    past = F.filter("_all", lambda c: over(c) <= start)
    here = F.filter("_all", lambda c: (over(c) > start) & (c["at"] + F.least(c["before"], c["after"]) < start + STRETCH))
    return rows.select("zone", "stretch", F.coalesce(F.try_element_at(past, F.lit(-1))["after"], F.col("_first")).alias("begins"), here.alias("changes"))


def resolve_walls(df: DataFrame, wall: str, zone: str, first_year: int = 1900, last_year: int = 2100) -> DataFrame:
    """df with (kind, at, later): what a wall clock is in the zone that its row names, as instants.

    exact (at), gap (the clock was set forward over it: no instant), overlap (it was twice: at and later);
    unknown-zone for a name that there isn't, out-of-range for another year; null where wall or zone is. Runs one
    pass over the zones of df, for which it is read twice. Input columns with the names of the new ones are an error.
    """
    if clash := {"kind", "at", "later"} & set(df.columns):
        raise ValueError(f"columns of these names exist: {sorted(clash)}")
    names = df.select(F.col(zone).alias("zone")).where(F.col("zone").isNotNull()).distinct()
    met = stretches(names, "zone", first_year, last_year).select(F.col("zone").alias("_zone"), F.col("stretch").alias("_stretch"), "begins", "changes")
    if len(names.limit(FEW + 1).take(FEW + 1)) <= FEW:
        met = F.broadcast(met)
    rows = df.select(F.struct("*").alias("_row"), F.col(wall).cast("timestamp_ntz").alias("_wall"), F.col(zone).alias("_named"))
    local = F.unix_seconds(F.col("_wall").cast("timestamp"))
    asked = F.year("_wall").between(first_year, last_year)
    rows = rows.join(met, (F.col("_named") == F.col("_zone")) & (F.floor(local / STRETCH) == F.col("_stretch")) & asked, "left")
    low, high = lambda c: c["at"] + F.least(c["before"], c["after"]), lambda c: c["at"] + F.greatest(c["before"], c["after"])
    inside = F.get(F.filter("changes", lambda c: (local >= low(c)) & (local < high(c))), F.lit(0))
    ruling = F.coalesce(F.try_element_at(F.filter("changes", lambda c: high(c) <= local), F.lit(-1))["after"], F.col("begins"))
    rows = rows.withColumn("_in", inside)
    gap = F.col("_in.after") > F.col("_in.before")
    kind = (
        F.when(F.col("_wall").isNull() | F.col("_named").isNull(), None).when(F.col("begins").isNull() & ~asked, "out-of-range").when(F.col("begins").isNull(), "unknown-zone")
        .when(F.col("_in").isNull(), "exact").when(gap, "gap").otherwise("overlap")
    )
    at = F.when(F.col("_in").isNull(), local - ruling).when(~gap, local - F.col("_in.before"))
    micros = F.unix_micros(F.col("_wall").cast("timestamp")) - local * 1_000_000
    moment = lambda s: F.timestamp_micros(s * 1_000_000 + micros)
    later = F.when(F.col("_in").isNotNull() & ~gap, local - F.col("_in.after"))
    return rows.select("_row.*", kind.alias("kind"), moment(at).alias("at"), moment(later).alias("later"))
