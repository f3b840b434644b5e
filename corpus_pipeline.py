"""A corpus pipeline over documents: language, quality, exact copies, near copies, then packing.

Stages before the last return the columns of documents, and drop only whole rows: texts of no learned
language, texts that the quality classifier doesn't give its threshold, exact copies but the one with
the smallest id, and near copies but one a group. Each is fitted on what it is given. Null and empty
texts have no language and go in the first stage; null and repeated ids are kept like others until a
copy of the text decides. An empty table gives an empty one. Columns with the name of something that a
stage computes come through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoframe.llm import exact, langid, packing, quality, simhash
from kairoframe.llm.common import remove, scratch, scratch_path, small_batches, unused

#: The least score of the quality classifier.
KEEP = 0.7


def where_judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], added: list[str], keep: Column) -> DataFrame:
    """The rows of docs that meet a condition on what `judge` appends, with docs' own columns as they were."""
    aside = {c: unused(docs, f"own_{c}")[0] for c in docs.columns if c.lower() in added}
    found = judge(docs.withColumnsRenamed(aside)).where(keep)
    return found.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and texts of some length that are like no learned language."""
    small_batches(spark)
    model = langid.learn(docs)
    return where_judged(docs, lambda d: langid.identify(d, model), ["lang_pred", "score", "likeness"], langid.accepted())


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what scores below the threshold; learned from the labels of the documents that remain.

    Where they don't have labels of both classes nothing is learned and nothing rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.learn(docs, labels)
    if not model.learned:
        return docs
    return where_judged(docs, lambda d: quality.score(d, model), ["score"], F.col("score") >= KEEP)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with exact.new_index(spark) as index:
        return exact.keep_first(docs, index, exact.halves(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", good_quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Learned models and tokenizers aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; of each only the rows that it keeps stay on disk, until the next is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
