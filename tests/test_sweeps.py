"""Zones of rows, overlapping periods and alignment of spans against loops over small data."""

import random
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from kairoframe.operators import alignment, periods, zones
from kairoframe.plans import catalog, catalog_sweeps

ROWS = "zone string, wall timestamp_ntz"


def by_zoneinfo(wall, zone):
    """Kind and epoch seconds from both folds."""
    made = [wall.replace(tzinfo=ZoneInfo(zone), fold=f) for f in (0, 1)]
    real = sorted({m.timestamp() for m in made if m.astimezone(timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == wall})
    return ("gap", "exact", "overlap")[len(real)], *(real + [None, None])[:2]


def test_walls_of_any_zone(spark):
    lord = [(2024, 4, 7, 1, 45), (2024, 10, 6, 2, 15), (2024, 10, 6, 2, 30), (2024, 4, 7, 1, 29), (1985, 6, 1, 0, 0)]
    saigon = [(1942, 12, 31, 23, 30), (1945, 3, 14, 23, 10), (1947, 4, 1, 0, 30), (1955, 7, 1, 0, 30), (1960, 1, 1, 0, 0), (1975, 6, 13, 0, 0), (1911, 5, 1, 0, 0), (2050, 1, 1, 0, 0)]
    york = [(2024, 3, 10, 2, 0), (2024, 3, 10, 3, 0), (2024, 11, 3, 1, 0), (2024, 11, 3, 2, 0), (2024, 11, 3, 0, 59), (1918, 3, 31, 2, 30), (2090, 7, 1, 12, 0)]
    apia = [(2011, 12, 30, 12, 0), (2011, 12, 29, 23, 59), (2011, 12, 31, 0, 0)]
    cases = [(z, datetime(*w)) for z, ws in (("Australia/Lord_Howe", lord), ("Asia/Ho_Chi_Minh", saigon), ("America/New_York", york), ("Pacific/Apia", apia)) for w in ws]
    got = zones.resolve_walls(spark.createDataFrame(cases, ROWS), "wall", "zone").select("zone", "wall", "kind", F.unix_seconds("at").alias("at"), F.unix_seconds("later").alias("later")).collect()
    assert {(r.zone, r.wall): (r.kind, r.at, r.later) for r in got} == {c: by_zoneinfo(c[1], c[0]) for c in cases}
    assert {r.kind for r in got} == {"exact", "gap", "overlap"}


def test_odd_walls(spark):
    noon = datetime(2024, 6, 1, 12, 0, 0, 250_000)
    cases = [("Asia/Tokyo", None), (None, noon), ("No/Where", noon), ("", noon), ("Asia/Tokyo", datetime(1800, 1, 1)), ("Asia/Tokyo", noon), ("Asia/Tokyo", noon), ("+07:00", noon)]
    df = spark.createDataFrame(cases, ROWS).withColumn("changes", F.lit(1)).withColumn("_zone", F.lit("x")).withColumnRenamed("zone", "at_zone")
    got = zones.resolve_walls(df, "wall", "at_zone").collect()
    assert sorted(("-" if r.at_zone is None else r.at_zone, r.kind or "-") for r in got) == sorted([("Asia/Tokyo", "-"), ("-", "-"), ("No/Where", "unknown-zone"), ("", "unknown-zone"), ("Asia/Tokyo", "out-of-range"), ("Asia/Tokyo", "exact"), ("Asia/Tokyo", "exact"), ("+07:00", "exact")])
    assert {r.at for r in got if r.at} == {datetime(2024, 6, 1, 3, 0, 0, 250_000), datetime(2024, 6, 1, 5, 0, 0, 250_000)} and {r["_zone"] for r in got} == {"x"}
    assert zones.resolve_walls(df.limit(0), "wall", "at_zone").count() == 0
    with pytest.raises(ValueError):
        zones.resolve_walls(df.withColumn("kind", F.lit(1)), "wall", "at_zone")


def made_periods(seed):
    rng = random.Random(seed)
    day = lambda: date(2020, 1, 1) + timedelta(rng.randrange(700))
    out = [(rng.choice(["a", "b", None]), s, s + timedelta(rng.choice([-3, 0, 1, 2, 5, 30]))) for s in (day() for _ in range(120))]
    return out + [("a", date(2019, 1, 1), date(2021, 6, 1))] * (seed % 2) + [("hot", date(2020, 1, 1) + timedelta(i % 50), date(2020, 1, 3) + timedelta(i % 50)) for i in range(2_000)] + [("a", None, date(2020, 1, 1)), ("a", date(2020, 1, 1), None)]


def taken(rows):
    days = {}
    for k, s, e in rows:
        if s and e:
            days.setdefault(k, set()).update(s + timedelta(i) for i in range((e - s).days))
    return days


@pytest.mark.parametrize("seed", [1, 2])
def test_disjoint_periods_and_days_outside(spark, seed):
    rows = made_periods(seed)
    df = spark.createDataFrame(rows, "k string, from_day date, to_day date")
    days = taken(rows)
    got = [(r.k, r.from_day, r.to_day) for r in periods.coalesced(df, ["k"]).collect()]
    assert taken(got) == {k: v for k, v in days.items() if v}
    for k in days:  # apart by a day at least
        mine = sorted((s, e) for kk, s, e in got if kk == k)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
    asked = [(k, date(2019, 12, 25) + timedelta(i), i) for i in range(760) for k in ("a", None, "none")] + [("a", None, 1)] * 2
    kept = periods.outside(spark.createDataFrame(asked, "k string, day date, month int"), df, ["k"])
    assert sorted(map(str, [tuple(r) for r in kept.collect()])) == sorted(str(a) for a in asked if a[1] not in days.get(a[0], set()))
    alone = periods.coalesced(df, [])
    assert taken([("", r.from_day, r.to_day) for r in alone.collect()])[""] == set().union(*days.values())
    assert periods.outside(kept, df.limit(0), ["k"]).count() == kept.count() and periods.coalesced(df.limit(0), ["k"]).count() == 0


def test_spans_against_tokens(spark):
    rng = random.Random(3)
    tokens, spans = [], []
    for k in ["a", "b", None]:
        for made, sizes in ((tokens, [1, 3, 7]), (spans, [0, 5, 12, 90])):
            at = 0
            while at < 600:
                size = rng.choice(sizes)
                made.append((k, at, at + size))
                at += size + rng.choice([0, 1, 4])
    tokens.append(("no spans", 0, 3))
    spans += [("no tokens", 2, 9), ("a", None, 3), ("a", 9, 5)]
    sane = [s for s in spans if s[1] is not None and s[1] <= s[2]]
    schema = "k string, start int, `end` int"
    sweep = alignment.swept(spark.createDataFrame(tokens, schema), spark.createDataFrame(spans, schema), ["k"], bucket=32)
    within = lambda t: next(((s[1], s[2]) for s in sane if s[0] == t[0] and s[1] <= t[1] and t[2] <= s[2]), None)
    assert sorted(map(str, ((r.k, r.start, r.end, r.span and tuple(r.span), r.aligned) for r in alignment.tokens_in(sweep).collect()))) == sorted(str((*t, within(t), within(t) is not None)) for t in tokens)
    cuts = lambda k, at: any(t[0] == k and t[1] < at < t[2] for t in tokens)
    held = {(r.k, r.start, r.end): (r.tokens, r.cut_start, r.cut_end, r.aligned) for r in alignment.spans_held(sweep, ["k"]).collect()}
    want = {}
    for s in sane:
        n, a, b = sum(t[0] == s[0] and within(t) == (s[1], s[2]) for t in tokens), cuts(s[0], s[1]), cuts(s[0], s[2])
        want[s] = (n, a, b, n > 0 and not a and not b)
    assert held == want
    assert alignment.swept(spark.createDataFrame([], schema), spark.createDataFrame([], schema), ["k"]).count() == 0


def test_periods_that_repeat_are_the_same_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET threads = 8")
    made = "SELECT 0 AS l_suppkey, (DATE '2000-01-01' + (i * 104729 % 900 * 3)::INT)::TIMESTAMP AS l_shipdate, 3.0::DOUBLE AS l_quantity FROM range(200000) t(i)"
    con.execute(f"CREATE TABLE lineitem AS {made}")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    wanted = con.execute(catalog.SQL["busy_periods"]).fetchall()
    got = [tuple(r) for r in catalog_sweeps.busy_periods(spark, str(tmp_path)).collect()]
    assert len(got) == 900 and sorted(got) == sorted(wanted)


def test_a_sweeps_tasks_grow_with_its_texts(spark, tmp_path, monkeypatch):
    seen, plain = [], alignment.swept
    monkeypatch.setattr(alignment, "swept", lambda *a, **k: (seen.append(plain(*a, **k)), seen[-1])[1])
    monkeypatch.setattr(catalog_sweeps, "TASK_PLACES", 500)
    spark.sql("select id conv_id, 0L turn, repeat('ab cde, ', 25) text from range(60) union all select 60, 0, null").write.parquet(str(tmp_path / "conversations.parquet"))
    assert catalog_sweeps.span_alignment(spark, str(tmp_path)).count() == 60 * 4
    assert seen[0].select(F.spark_partition_id()).distinct().count() > 4  # a shuffle has four
