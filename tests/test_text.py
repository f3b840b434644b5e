"""Text functions against the standard library and loops."""

import unicodedata

from pyspark.sql import functions as F

from kairoframe.functions import civil, lexicon, text
from kairoframe.operators import islands, recurrence

SAMPLES = ["thứ hai tuần sau", "Ngày Tết", "đường", "", "🎉 15h", "\u00e9", "x\u0301y", "\u0301a", "a\nq\u0323\u0302c", "ấ" * 700 + " 🎉"]


def test_composition_gives_what_nfc_gives_and_where_it_came_from(spark):
    """For Vietnamese letters; marks that none of them has stay where they are."""
    parts = ["a\u0323\u0302", "a\u0302\u0323", "\u00e2\u0323", "\u1ea1\u0302", "u\u031b\u0301ng"]
    given = [form for s in SAMPLES for form in (s, unicodedata.normalize("NFD", s))] + parts
    rows = spark.createDataFrame([(s,) for s in given], "t string").select("t", text.composed(F.col("t")).alias("c"), text.sources(F.col("t")).alias("at")).collect()
    for r in rows:
        assert r["c"] == unicodedata.normalize("NFC", r["t"])
        units = len(r["c"].encode("utf-16-le")) // 2
        assert len(r["at"]) == units + 1 and r["at"][-1] == len(r["t"].encode("utf-16-le")) // 2 and r["at"] == sorted(r["at"])
    by = {r["t"]: r["at"] for r in rows}
    assert [by[p] for p in parts] == [[2, 3], [2, 3], [1, 2], [1, 2], [2, 3, 4, 5]] and by["x\u0301y"] == [0, 1, 2, 3]


def test_decomposed_texts_meet_the_lexicon(spark):
    rows = spark.createDataFrame([(unicodedata.normalize("NFD", w),) for w in ("Hôm  Nay", "thứ bảy", "mười lăm")], "t string")
    found = rows.select(lexicon.lookup(lexicon.RELATIVE_DAYS, text.key(F.col("t"))), lexicon.lookup(lexicon.WEEKDAYS, text.key(F.col("t")))).collect()
    assert [tuple(r) for r in found] == [(0, None), (None, 5), (None, None)]


def test_hash_counts_utf16_units(spark):
    def naive(s):
        value = 2166136261
        data = s.encode("utf-16-le")
        for i in range(0, len(data), 2):
            value = ((value ^ int.from_bytes(data[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return value

    rows = spark.createDataFrame([(s,) for s in SAMPLES], "t string").select("t", text.fnv(F.col("t")).alias("h"), text.length_bucket(F.col("t")).alias("b")).collect()
    assert all(r["h"] == naive(r["t"]) for r in rows)
    assert spark.range(1).select(text.length_bucket(F.lit("🎉"))).head()[0] == 1


def test_running_sums_of_long_arrays(spark):
    rows = spark.createDataFrame([([1] * n,) for n in (0, 1, 63, 64, 65, 128, 5000)], "a array<int>").select(F.size("a"), text.running(F.col("a"))).collect()
    assert all(r[1] == list(range(r[0])) for r in rows)


def test_leap_days(spark):
    days = ["1899-03-01", "1900-02-28", "2000-02-29", "2000-03-01", "2096-03-01", "2023-01-01"]
    rows = spark.createDataFrame([(d,) for d in days], "d string").select(civil.month_day_next(F.col("d").cast("date"), 2, 29)).collect()
    assert [str(r[0]) for r in rows] == ["1904-02-29", "1904-02-29", "2000-02-29", "2004-02-29", "2104-02-29", "2024-02-29"]


def test_positions_against_dateutil(spark):
    from datetime import date, datetime

    from dateutil.rrule import MONTHLY, rrule

    start, end = date(2026, 1, 20), date(2027, 2, 27)
    for on, nth in (([0, 1, 2, 3, 4], -1), ([5, 6], 1), ([2], 5), ([0, 4], 3), ([6], -5), ([0, 1, 2, 3, 4, 5, 6], 31)):
        got = spark.range(1).select(recurrence.positions(F.lit(start), F.lit(end), on, nth)).head()[0]
        assert got == [d.date() for d in rrule(MONTHLY, byweekday=on, bysetpos=nth, dtstart=datetime(2026, 1, 20), until=datetime(2027, 2, 27))], (on, nth)


def test_runs_and_sessions_across_buckets(spark):
    import random

    rng = random.Random(1)
    data = [(k, i, i * rng.choice([1, 1, 40]), rng.choice("aab")) for k in (1, None) for i in range(300)]
    data = [(k, i, sum(d[2] for d in data if d[0] == k and d[1] <= i), v) for k, i, _, v in data]
    rows = spark.createDataFrame(data, "k int, i int, s long, v string")
    for width in (1, 7, 1000, 10**9):
        found = islands.runs(rows, ["k"], ["s", "i"], "v", F.floor(F.col("s") / width))
        found = {(r["k"], r["i"]): r for r in islands.sessions(found, ["k"], F.col("s"), 500, "i", width).collect()}
        assert len(found) == len(data)
        for k in (1, None):
            run = session = 0
            before = None
            for _, i, s, v in sorted((d for d in data if d[0] == k), key=lambda d: (d[2], d[1])):
                run += before is None or before[1] != v
                session += before is None or s - before[0] > 500
                before = (s, v)
                assert (found[k, i]["run"], found[k, i]["session"]) == (run, session)


def test_strides_of_uneven_columns(spark):
    ids = sorted({*range(50), *(10**6 + i for i in range(500)), 10**12})
    rows = spark.createDataFrame([(i,) for i in ids], "i long")
    for size in (10, 10**6):
        assert sorted(r[0] for r in islands.stride(rows, "i", 7, size).collect()) == ids[::7]
    assert islands.stride(rows.limit(0), "i", 7).count() == 0


def test_first_rows_of_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"))
    got = recurrence.top(rows, "k", ["o"], 3).collect()
    assert sorted(r["o"] for r in got if r["k"] == 1) == [0, 1, 2] and all(r["truncated"] == (r["k"] == 1) for r in got) and len(got) == 1003
