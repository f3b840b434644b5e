"""Connected components against union-find, and how many rows their joins make."""

import random

from kairoframe.llm import common


def by_hand(edges):
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    return {v: root(v) for v in list(up)}


def test_components_of_odd_shapes(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(900, 500 + i) for i in range(30)]  # a chain, a star around its largest
    zigzag = [v for pair in zip(range(2_000, 2_020), range(2_059, 2_039, -1), strict=True) for v in pair]
    edges += list(zip(zigzag[1:], zigzag, strict=False)) + [(rng.randrange(3_000, 3_060), rng.randrange(3_000, 3_060)) for _ in range(40)]
    rows = spark.createDataFrame([*edges, (7, 7), (None, 1), (3, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(rows).collect()}
    assert got == by_hand([(a, b) for a, b in edges if a != b])
    texts = rows.selectExpr("cast(cast(a as string) as binary) a", "cast(cast(b as string) as binary) b")
    assert len({bytes(r["component"]) for r in common.connected_components(texts).collect()}) == len(set(got.values()))
    assert common.connected_components(rows.limit(0)).count() == 0


def test_links_of_a_dense_group_are_joined_once(spark, monkeypatch):
    rng = random.Random(6)
    edges = sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(4_000)})
    rows = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")
    made, join = [], type(rows).join

    def counted(*args, **named):
        out = join(*args, **named)
        made.append(out.count())
        return out

    monkeypatch.setattr(type(rows), "join", counted)
    assert {r["component"] for r in common.connected_components(rows).collect()} == {0}
    assert max(made) <= len(edges) and sum(made) <= 3 * len(edges)  # both ends of each link, and what is left of them
