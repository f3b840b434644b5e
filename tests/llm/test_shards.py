"""What shards of words take on their way: rows of the exchange, pages of the written table, batches to Python."""

import collections
import glob
import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from kairoframe.llm import collocations, registry


def test_pairs_and_triples_cross_the_exchange_in_lists(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    rows = [("en", " ".join(rng.choices(words, k=30_000)) + " a b c" * 20) for _ in range(2)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    made, map_in_arrow = {}, type(docs).mapInArrow

    def counted(df, run, schema, *more, **named):
        out = map_in_arrow(df, run, schema, *more, **named)
        if "gram" in schema and schema != "gram long":
            made[len(made)] = out.count()
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    monkeypatch.setattr(collocations, "SPREAD", 200)  # more parts than the usual 256
    known, _ = collocations.counts(docs, 5, 5, 10_000, 1 << 16)
    found = {r["phrase"]: r["f"] for r in known.where("phrase like '% %'").collect()}
    expected = collections.Counter()
    for _, text in rows:
        own = text.split(" ")
        for size in range(2, 6):
            expected.update(" ".join(own[i : i + size]) for i in range(len(own) - size + 1))
    assert found == {p: n for p, n in expected.items() if n >= 5} and found["a b c"] == 40
    assert len(made) == 2 and max(made.values()) <= 2 * 512 < len(found)  # a list for each part and task, where each pair was a row


def test_lists_of_hashes_add_up(monkeypatch):
    monkeypatch.setattr(collocations, "HANDED", 700)  # several lists of a part from one task
    rng, least = random.Random(4), 6
    sequences = [np.array([rng.randrange(1, 21) for _ in range(500)], np.int32) for _ in range(5)]
    known = [f"w{i}" for i in range(20)]
    shards = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(["\n".join(known)] * 5), pa.array([s.tobytes() for s in sequences])], names=["lang", "vocabulary", "sequence"])
    everything = type("Sent", (), {"value": collocations.zlib.compress(np.full(8, 255, np.uint8))})
    for parts in (256, 1024):
        lists = pa.Table.from_batches(collocations.chain_counts([everything], least, parts)(iter([shards])))
        assert len(lists) > len(lists.column("part").unique())
        got = set()
        for part in lists.column("part").unique():
            got |= set(collocations.passing(least)(lists.filter(pa.compute.equal(lists.column("part"), part))).column("gram").to_pylist())
        own = collocations.word_hashes("en", known)
        pairs = collections.Counter(p for s in sequences for p in itertools.pairwise(s.tolist()))
        mask = (parts << 32) - 1
        assert got == {int(collocations.mixed(own[a : a + 1], own[b : b + 1])[0]) & mask for (a, b), n in pairs.items() if n >= least}
    bits = collocations.opened(next(collocations.bitmap(24)(iter([pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.int64())], names=["gram"])]))).column(0)[0].as_py())
    whole = [collocations.mixed(own[a : a + 1], own[b : b + 1]) for (a, b), n in pairs.items() if n >= least]
    assert collocations.inside(bits, np.concatenate(whole)).all()  # whole hashes meet the bits of shortened ones, whatever the number of bits


def test_shards_are_written_in_groups_of_rows_that_a_reader_can_hold(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5_000)]
    docs = spark.createDataFrame([(f"l{i}", " ".join(rng.choices(words, k=200_000))) for i in range(16)], "lang string, text string").coalesce(1)
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{base}/shards-*"))
    collocations.counts(docs, 1_000_000, 5, 1 << 18, 1 << 16)
    files = [pq.ParquetFile(f).metadata for folder in set(glob.glob(f"{base}/shards-*")) - before for f in glob.glob(f"{folder}/*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 16 and max(g.total_byte_size for g in groups) < 7_000_000 < sum(g.total_byte_size for g in groups)


def test_shards_go_to_python_in_small_batches(spark, monkeypatch, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, at_work = spark.conf.get(name), []
    spark.createDataFrame([("en", "a b")], "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(collocations, "mine", lambda docs: at_work.append(spark.conf.get(name)) or docs)
    registry.op11_collocations(spark, str(tmp_path))
    assert at_work[0].rstrip("b") in ("4m", str(4 << 20)) and spark.conf.get(name) == before
