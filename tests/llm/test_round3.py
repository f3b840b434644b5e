"""Collocations, mixing and whitening against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kairoframe.llm import collocations, mixing, whitening


def phrases_by_hand(rows, least, longest, first):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    out = collections.defaultdict(list)
    many = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = collections.defaultdict(int)
    for (lang, p), a in many.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                inside[lang, p[i : i + size]] = max(inside[lang, p[i : i + size]], a)
    for (lang, p), a in many.items():
        if 100 * inside[lang, p] >= 100 * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang in out for i, (s, a, p, left, right) in enumerate(sorted(out[lang])[:first])}


def test_collocations_are_those_of_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(["a", "B", "c.", "é", "d,e", "f\n", "\t"]) for _ in range(rng.randrange(60)))) for _ in range(80)]
    rows += [("en", "New York City is new york city. a a a a a a a")] * 9 + [("en", None), ("en", ""), ("x", "!?"), ("de", "b " * 5_000)]
    docs = spark.createDataFrame([(l, t, "n") for l, t in rows], "lang string, text string, n string")
    for shard, slots, least, first in ((50, 8, 3, 2_000), (1 << 20, 1 << 16, 10, 7)):  # a full bitmap lets all through
        got = {tuple(r) for r in collocations.mine(docs, least, 5, first, shard, slots).collect()}
        assert got == phrases_by_hand(rows, least, 5, first)
    assert collocations.mine(docs.limit(0)).count() == 0


def test_phrases_of_shards_are_added_up_before_they_are_rows(spark, monkeypatch):
    text = " ".join(random.Random(7).choices("abcdefgh", k=4_000))
    rows = [(lang, text) for lang in ("en", "de\nx") for _ in range(12)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    made, map_in_arrow = [], type(docs).mapInArrow

    def counted(df, run, schema, *more, **named):
        out = map_in_arrow(df, run, schema, *more, **named)
        if schema == "lang string, phrase string, f long":
            made.append(out.where("phrase like '% %'").count())
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    known, _ = collocations.counts(docs, 12, 5, 4_000, 1 << 16)
    many = {tuple(r) for r in known.where("phrase like '% %'").collect()}
    assert len(many) > 1_000 and sum(made) <= 1.1 * len(many)  # not once a shard
    monkeypatch.setattr(collocations, "GATHERED", 8)  # without Spark: what passes the limit is handed on, and nothing is lost
    tables = [pa.table([["en"] * 9, list("abcdefghi"), [1] * 9], schema=collocations.FIELDS)] * 5
    parts = list(collocations.gathered(iter(tables), 9))
    assert len(parts) == 5 and sum(map(len, collocations.gathered(iter(tables)))) == 9
    assert sorted(map(tuple, map(dict.values, collocations.added(parts).to_pylist()))) == [("en", c, 5) for c in "abcdefghi"]


def test_stretches_go_into_automata_of_bounded_size(monkeypatch):
    monkeypatch.setattr(collocations, "SYMBOLS", 10)
    found = {np.arange(i, i + 4, dtype=np.int32).tobytes(): i + 1 for i in range(20)}
    parts = list(collocations.portions(found))
    assert dict(x for part in parts for x in part) == found and max(sum(len(key) // 4 for key, _ in part) for part in parts) < 14


def test_bitmaps_are_sent_compressed():
    hashes = pa.RecordBatch.from_arrays([pa.array(np.arange(0, 1 << 40, 1 << 33), pa.int64())], names=["gram"])
    made = [next(collocations.bitmap(1 << 26)(iter([part]))).column(0)[0].as_py() for part in (hashes.slice(0, 60), hashes.slice(60))]
    both = collocations.united(iter(made), 1 << 26)
    assert max(map(len, [*made, both])) < 100_000  # of 8 MB
    assert collocations.inside(collocations.opened(both), np.asarray(hashes.column(0)).view(np.uint64)).all()


def test_automaton_counts_all_substrings():
    rng = random.Random(1)
    runs = [([rng.randrange(3) for _ in range(rng.randrange(1, 12))], rng.randrange(1, 4)) for _ in range(60)]
    automaton, text = collocations.SuffixAutomaton(), []
    expected = collections.Counter()
    for run, weight in runs:
        automaton.add(run, len(text), weight)
        text += run
        for i in range(len(run)):
            for j in range(i + 2, min(len(run), i + 5) + 1):
                expected[tuple(run[i:j])] += weight
    got = [(tuple(text[e - size + 1 : e + 1]), int(n)) for size, ends, times in automaton.substrings(5) for e, n in zip(ends, times, strict=True)]
    assert len(got) == len(expected) and dict(got) == expected


def sainte_lague(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min((-v / (2 * won[k] + 1), k) for k, v in votes.items() if v > 0)[1]
        won[best] += 1
    return won


def test_apportionment_gives_the_highest_quotients(spark):
    rng = random.Random(2)
    groups = {seats: {k: rng.choice([0, 1, 7, 7, 100, 12_345]) for k in range(30)} for seats in (0, 1, 5, 40, 333)}
    rows = spark.createDataFrame([(seats, k, v) for seats, votes in groups.items() for k, v in votes.items()], "seats long, k long, v long")
    got = {(r["seats"], r["k"]): r["quota"] for r in mixing.apportion(rows, "v", "seats", ["seats", "k"], ["seats"]).collect()}
    assert got == {(seats, k): n for seats, votes in groups.items() for k, n in sainte_lague(votes, seats).items()}


def test_mix_meets_its_targets(spark, monkeypatch):
    rng = random.Random(3)
    sources = ["b", "a", None, "big", "empty", "tiny", "Z"]
    rows = [(i, rng.choice(["big"] * 4 + sources[:4]), "w " * rng.choice([0, 1, 9, 80, 700]), "x") for i in range(400)]
    rows += [(9_000, "empty", None, "x"), (9_001, "empty", "", "x"), (9_002, "tiny", "one two\x0bthree", "x"), (None, "Z", "a b", "x"), (None, "Z", "a b", "x"), (9_003, "big", "long " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    monkeypatch.setattr(mixing, "SHARD", 3_000)
    got = mixing.mix(docs, spans=True).collect()
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(s["times"] * (s["stop"] - s["begin"]) for s in r["spans"])
        assert all(0 <= s["begin"] < s["stop"] <= r["size"] for s in r["spans"])
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, left, expected = set(names), sum(size.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        for s in over:
            expected[s] = 3 * size[s]
            left -= 3 * size[s]
        open_ -= over
    expected |= {s: weight[s] * level for s in open_}
    for s in names:
        assert target[s] == pytest.approx(expected[s], rel=1e-12)
        assert abs(taken[s] - target[s]) <= 3 + 0.02 * target[s]
    assert sorted(map(str, mixing.mix(docs.repartition(3), spans=True).collect())) == sorted(map(str, got))
    ids = docs.where("doc_id is not null")
    pieces = collections.Counter()
    for r in mixing.texts(ids).collect():
        pieces[r["doc_id"]] += len(r["piece"].split())
    assert pieces == {r["doc_id"]: r["taken"] for r in mixing.mix(ids).where("taken > 0").collect()}
    assert mixing.mix(docs.limit(0)).count() == 0


def whitened_by_hand(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    v = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(np.atleast_2d(v))
    return x, values[::-1][:k], axes[:, ::-1][:, :k], np.trace(np.atleast_2d(v))


def test_whitening_is_that_of_a_full_decomposition(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(c) for c in np.float32(v)] for v in rng.standard_normal((300, 24)) @ np.diag(np.linspace(3, 0.1, 24))]
    bad = [(-1, None), (-2, [None] * 24), (-3, [float("nan")] * 24), (-4, [float("inf")] + [0.0] * 23)]
    docs = spark.createDataFrame([(i, v, "a") for i, v in list(enumerate(vectors)) + bad], "vec_id long, embedding array<float>, n string").repartition(3)
    x, values, axes, trace = whitened_by_hand(vectors, 8)
    got = collections.defaultdict(dict)
    for r in whitening.whiten(docs).collect():
        got[r["component"]][r["vec_id"]] = r
    sums = [int(s) for s in x.sum(0)]
    for c in range(1, 9):
        mine = np.array([got[c][i]["whitened"] for i in range(300)])
        true = (x - x.mean(0)) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert np.abs(mine * np.sign(mine @ true) - true).max() < 1e-8
        assert got[c][0]["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9) and got[c][0]["identity_error"] < 1e-9
        assert len(got[c]) == got[c][0]["n"] == 300
    for i in (0, 7):
        assert got[1][i]["deviation"] == sum((300 * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True))


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    rows = lambda *r: whitening.whiten(spark.createDataFrame(list(r), schema)).collect()
    assert rows() == [] and rows((1, [1.0, 2.0]), (2, [1.0, 2.0])) == [] and rows((1, None)) == [] and rows((1, [])) == []
    short = rows((1, [1.0]), (1, [1.0]), (2, [0.0, 3.0]), (None, [0.0, 0.0]))  # one filled up, one twice, one without an id
    assert {r["component"] for r in short} == {1, 2} and len(short) == 8 and short[0]["identity_error"] < 1e-9
    huge = rows((1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [1e300, 1.0]))
    assert huge and all(np.isfinite(r["whitened"]) for r in huge)
    copies = rows(*[(i, [float(i % 2), 5.0]) for i in range(10)])
    assert len(copies) == 10 and {round(abs(r["whitened"]), 9) for r in copies} == {1.0} and copies[0]["explained"] == pytest.approx(1)


def test_a_lost_block_is_drawn_anew():
    operator = np.diag([5.0, 4.0] + [0.0] * 20)
    values, axes = whitening.lanczos(lambda q: operator @ q, 22, 4, 2, 512, 1e-13, 1)
    assert values == pytest.approx([5, 4, 0, 0]) and np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12


def test_restarts_converge():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    operator = q @ np.diag(2.0 ** -np.arange(60)) @ q.T
    values, axes = whitening.lanczos(lambda v: operator @ v, 60, 4, 2, 10, 1e-13, 1)
    assert values == pytest.approx(2.0 ** -np.arange(4), rel=1e-12) and np.abs(np.abs((axes * q[:, :4]).sum(0)) - 1).max() < 1e-10
