"""The Vietnamese lunisolar calendar as a table of lunar months made by Spark.

Each lunation's new moon and the sun's sector at its start are Column arithmetic over its number. A
month where the sector passes the winter solstice is the eleventh; between two such months there are
twelve or thirteen, and of thirteen the first that passes no sector repeats the number before it. The
table has a row a lunation, so dates meet it by an equality on the days of its months.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Series of the mean and true new moon (Jean Meeus, Astronomical Formulae for Calculators, on the
# phases of the moon; lunations from 1900) and of the sun's longitude (Astronomical Algorithms, low accuracy).
# Polynomials are their coefficients by rising powers of the centuries; those of lunations have the one of the
# lunation's number apart. Terms are (coefficient, multiples of the sun's anomaly, the moon's and its latitude argument).
LUNATION_YEARS = 1236.85
MEAN_MOON, MEAN_MOON_EACH = (2415020.75933, 0, 0.0001178, -0.000000155), 29.53058868
MEAN_MOON_WAVE, MEAN_MOON_ANGLE = 0.00033, (166.56, 132.87, -0.009173)
SUN_ANOMALY, SUN_ANOMALY_EACH = (359.2242, 0, -0.0000333, -0.00000347), 29.10535608
MOON_ANOMALY, MOON_ANOMALY_EACH = (306.0253, 0, 0.0107306, 0.00001236), 385.81691806
LATITUDE, LATITUDE_EACH = (21.2964, 0, -0.0016528, -0.00000239), 390.67050646
SUN_TERM = (0.1734, -0.000393)
CLOCK_BEFORE_800, CLOCK_AFTER = (0.001, 0.000839, 0.0002261, -0.00000845, -0.000000081), (-0.000278, 0.000265, 0.000262)
SUN_EPOCH, CENTURY = 2451545, 36525
SUN_MEAN, SUN_MEAN_ANOMALY = (280.46645, 36000.76983, 0.0003032), (357.5291, 35999.0503, -0.0001559, -0.00000048)
SUN_CENTRE = [(1.9146, -0.004817, -0.000014), (0.019993, -0.000101), (0.00029,)]
MOON_TERMS = [
    (0.0021, 2, 0, 0), (-0.4068, 0, 1, 0), (0.0161, 0, 2, 0), (-0.0004, 0, 3, 0), (0.0104, 0, 0, 2), (-0.0051, 1, 1, 0), (-0.0074, 1, -1, 0),
    (0.0004, 1, 0, 2), (-0.0004, -1, 0, 2), (-0.0006, 0, 1, 2), (0.0010, 0, -1, 2), (0.0005, 1, 2, 0),
]
#: Fixed value: the zone of the calendar, hours east.
ZONE = 7
RAD = math.pi / 180


def julian_day(day: Column) -> Column:
    """The Julian day number of a Gregorian date."""
    return F.unix_date(day) + 2440588


def polynomial(coefficients: tuple, t: Column) -> Column:
    return sum(((F.lit(c) * t**i if i else F.lit(c)) for i, c in enumerate(coefficients) if c), F.lit(0.0))


def new_moon(k: Column) -> Column:
    """The Julian date of the k-th new moon after 1900."""
    t = k / LUNATION_YEARS
    at = lambda series, each: polynomial(series, t) + each * k
    mean = at(MEAN_MOON, MEAN_MOON_EACH) + MEAN_MOON_WAVE * F.sin(polynomial(MEAN_MOON_ANGLE, t) * RAD)
    sun, moon, lat = at(SUN_ANOMALY, SUN_ANOMALY_EACH), at(MOON_ANOMALY, MOON_ANOMALY_EACH), at(LATITUDE, LATITUDE_EACH)
    shift = polynomial(SUN_TERM, t) * F.sin(sun * RAD)
    for c, a, b, d in MOON_TERMS:
        shift = shift + c * F.sin(RAD * (a * sun + b * moon + d * lat))
    return mean + shift - F.when(t < -11, polynomial(CLOCK_BEFORE_800, t)).otherwise(polynomial(CLOCK_AFTER, t))


def sun_sector(jdn: Column) -> Column:
    """Which twelfth of its course the sun is in at local midnight of a day."""
    t = (jdn - 0.5 - ZONE / 24 - SUN_EPOCH) / CENTURY
    anomaly = polynomial(SUN_MEAN_ANOMALY, t)
    centre = sum((polynomial(c, t) * F.sin(RAD * n * anomaly) for n, c in enumerate(SUN_CENTRE, 1)), F.lit(0.0))
    return F.floor(F.pmod(polynomial(SUN_MEAN, t) + centre, F.lit(360.0)) / 30).cast("int")


def lunar_months(spark: SparkSession, first: int = 1900, last: int = 2100) -> DataFrame:
    """(year, month, leap, start_jdn, length) of the lunar months that begin in these years and a bit around.

    One window runs over the lunations of the range, some twelve a year: a dimension of fixed size.
    """
    low, high = (int((y - 1900) * 12.3685) for y in (first - 2, last + 3))
    rows = spark.range(low, high, 1, 4).select(F.col("id").alias("k"), F.floor(new_moon(F.col("id")) + 0.5 + ZONE / 24).alias("start_jdn"))
    w = Window.orderBy("k")
    rows = rows.select("k", "start_jdn", (F.lead("start_jdn").over(w) - F.col("start_jdn")).alias("length"), sun_sector(F.col("start_jdn")).alias("sector"))
    rows = rows.withColumn("next_sector", F.lead("sector").over(w))
    rows = rows.withColumn("winter", (F.col("sector") <= 8) & (F.col("next_sector") >= 9)).withColumn("course", F.sum(F.col("winter").cast("int")).over(w))
    of = Window.partitionBy("course").orderBy("k")
    rows = rows.withColumn("place", F.row_number().over(of) - 1).withColumn("size", F.count("*").over(Window.partitionBy("course")))
    bare = (F.col("sector") == F.col("next_sector")) & (F.col("size") == 13) & (F.col("place") > 0)
    rows = rows.withColumn("bare", F.coalesce(bare, F.lit(False))).withColumn("leaps", F.sum(F.col("bare").cast("int")).over(of))
    rows = rows.withColumn("leap", F.col("bare") & (F.col("leaps") == 1))
    number = F.col("place") - F.least("leaps", F.lit(1))
    start = F.date_from_unix_date((F.col("start_jdn") - 2440588).cast("int"))
    month = (F.pmod(number + 10, F.lit(12)) + 1).cast("int")
    year = F.when((month >= 11) & (F.month(start) <= 2), F.year(start) - 1).otherwise(F.year(start))
    found = rows.where(F.col("length").isNotNull() & (F.col("course") > 0)).select(year.alias("year"), month.alias("month"), "leap", F.col("start_jdn").cast("int").alias("start_jdn"), F.col("length").cast("int").alias("length"))
    return found.where(F.col("year").between(first, last))


def to_lunar(dates: DataFrame, column: str, months: DataFrame) -> DataFrame:
    """Append lunar_year, lunar_month, lunar_day and lunar_leap; null outside the table's years."""
    days = months.select(
        F.col("year").alias("lunar_year"), F.col("month").alias("lunar_month"), F.col("leap").alias("lunar_leap"), F.explode(F.sequence(F.lit(1), "length")).alias("lunar_day"), "start_jdn",
    ).withColumn("_jdn", F.col("start_jdn") + F.col("lunar_day") - 1)
    return dates.withColumn("_jdn", julian_day(F.col(column))).join(days.drop("start_jdn"), "_jdn", "left").drop("_jdn")


def cycle(year: Column) -> Column:
    """A lunar year's place in the cycle of sixty, from 0."""
    return F.pmod(year - 4, F.lit(60))
