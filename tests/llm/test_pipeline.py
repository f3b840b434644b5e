"""The stages and the whole pipeline on small tables with odd rows, held against what must stay."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")

WORDS = {"en": "the and of to in that it was for on with as his they at be this have from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split()}


def text(lang, seed, length=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "en", "ing", "lich"]) for _ in range(length))


def junk(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["BUY!!", "CLICK!!", "WIN!!", "FREE!!"]) for _ in range(60))


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, text("en" if i % 2 else "de", i), "en" if i % 2 else "de") for i in range(40)]
    rows += [(100 + i, junk(i), "en") for i in range(30)]
    copy = text("en", 1)
    rows += [(200, copy.replace(" ", "  "), "en"), (0, copy, "en"), (None, copy, "en"), (None, None, None), (201, None, "en"), (202, "", "de"), (203, "12 34 !", "en")]
    rows += [(300, text("de", 2) + " zusatz", "de"), (301, "xqzt kjwq zzxv wqkj " * 10, None), (1, "other text of the same id, to be kept and of", "en"), (302, text("en", 9, 30_000), "en")]
    # columns named like what the stages compute
    schema = "doc_id long, text string, lang string, score string, LANG_PRED int, digest string, own_digest int, key string, gone_id int"
    docs = spark.createDataFrame([(*r, f"s{i}", i, "d", i, "k", i) for i, r in enumerate(rows)], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_keep_rows_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {tuple(r) for r in docs.collect()}
    place = docs.columns.index("LANG_PRED")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        got = [tuple(r) for r in docs.collect()]
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns and set(got) <= rows
        kept[name] = {r[place] for r in got}
        docs = spark.createDataFrame(got, docs.schema)
    everything = {r[place] for r in rows}
    first = {r[place]: r for r in rows}
    gone = lambda a, b: {first[i][:2] for i in a - b}
    assert gone(everything, kept["language"]) == {(None, None), (201, None), (202, ""), (203, "12 34 !"), (301, "xqzt kjwq zzxv wqkj " * 10)}
    assert {i for i, _ in gone(kept["language"], kept["quality"])} == set(range(100, 130))
    copy = text("en", 1)
    assert gone(kept["quality"], kept["exact_dedup"]) == {(200, copy.replace(" ", "  ")), (1, copy), (None, copy)}
    assert gone(kept["exact_dedup"], kept["near_dedup"]) == {(300, text("de", 2) + " zusatz")}


def test_the_whole_pipeline_packs_what_is_kept(spark, folder):
    import public_tokenizers

    rows = pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [(i, text("en" if i % 2 else "de", i)) for i in range(40) if i != 1]
    wanted += [(0, text("en", 1)), (1, "other text of the same id, to be kept and of"), (302, text("en", 9, 30_000))]
    sizes = sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in wanted)
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == sizes
    ids = tokenizer.encode(text("de", 2), add_special_tokens=False).ids + [1]
    own = [r for r in rows if r["doc_id"] == 2]
    assert sum(r["length"] for r in own) == len(ids)
    assert {r["ids_crc32"] for r in own} == {zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own}


def test_empty_tables_and_no_labels(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("doc_id > 1000"), folder).count() == 0
    none = tmp_path / "none"
    docs.limit(0).select("doc_id", F.lit(1).alias("quality")).write.parquet(str(none / "labels.parquet"))
    assert pipeline.good_quality(spark, docs, str(none)).count() == docs.count()
