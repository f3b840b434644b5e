"""Exact deduplication against a persistent digest index.

Texts are equal when they are the same after each run of ASCII white space becomes one space; null
counts as empty. The index is a table bucketed and sorted by digest. Documents come to it in batches,
each with a name: a batch is grouped by digest first, so a digest that a third of its rows share is one
row before anything is joined; what the index doesn't know is found by a sort-merge anti-join, which
reads the index by bucket without a shuffle, and appended as founding rows, with the smallest id of the
batch. For digests that it knows already the batch's number of rows is appended. Verdicts are then read
from the index: a document stays if it has the founding id and came with the founding batch.

A batch that is added again under its name, because a job was lost or is repeated, appends only what of
it is missing and gets the same verdicts. One writer at a time is assumed: two batches that are added at
once may both found a digest; each writer may then keep its document, and readers from then on see the
founding row with the smallest id.

Repeated rows count each; of rows with equal ids either stands for both; a null id loses to any other.
An empty table gives no rows. Columns besides the id and the text are not read by `assign`, and
`keep_first` hands them on as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, plain, release, remove, scratch_path, unused

WHITE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " "), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest)"""
    return plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))


class DigestIndex:
    """Digests at a location that outlives the session; opened again, it goes on where it was.

    Rows are (digest, keep_id, rows, founder, batch): one for each digest of each batch.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, passing: bool = False):
        self.spark, self.path, self.buckets, self.passing = spark, path, int(buckets), passing
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, `rows` BIGINT, founder BOOLEAN, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Forget the table's name in the catalog; its files stay, unless the index is a passing one."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.passing:
            remove(self.spark, self.path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, found: DataFrame, batch: str) -> None:
        """Append what of a batch's (doc_id, digest) the index hasn't yet."""
        groups = found.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("rows"))
        groups = materialise(groups.join(self.rows().where(F.col("batch") == batch).select("digest").hint("merge"), "digest", "left_anti"), "digests")
        known = self.rows().where("founder").where(F.col("batch") != batch).select("digest").hint("merge")
        fresh = groups.join(known, "digest", "left_anti").withColumn("founder", F.lit(True))
        again = groups.join(known, "digest", "left_semi").withColumn("founder", F.lit(False))
        rows = materialise(fresh.union(again).withColumn("batch", F.lit(batch)), "digest-rows")
        rows.repartition(self.buckets, "digest").select("digest", "keep_id", "rows", "founder", "batch").write.insertInto(self.table)
        release(groups, rows)

    def verdicts(self) -> DataFrame:
        """(digest, keep_id, batch, group_size) of every digest, as the index has it."""
        first = F.min(F.when(F.col("founder"), F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "batch"))).alias("first")
        return self.rows().groupBy("digest").agg(first, F.sum("rows").alias("group_size")).select("digest", "first.keep_id", "first.batch", "group_size")


def assign(docs: DataFrame, index: DigestIndex, batches: list[tuple[str, Column | str]]) -> DataFrame:
    """One row for each document: (doc_id, keep_id, group_size, kept, digest), appending to the index.

    The documents are added in batches, (name, condition on doc_id or its SQL), in order; each document must meet
    exactly one. The join reads two exchanges, so adaptive execution splits a digest that many share.
    """
    found = materialise(digests(docs), "document-digests")
    for name, where in batches:
        index.add(found.where(where), name)
    told = materialise(index.verdicts().join(found.select("digest").distinct(), "digest", "left_semi"), "digest-verdicts")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("batch").isin([name for name, _ in batches])
    return found.join(told, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def halves(docs: DataFrame) -> list[tuple[str, Column]]:
    """Two batches of about as many documents, the smaller ids first, so that the founding id is the smallest of all."""
    middle = plain(docs, "doc_id").agg(F.percentile_approx(F.col("doc_id").cast("long"), 0.5)).head()[0]
    first = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False))
    return [("first", first), ("second", ~first)]


def keep_first(docs: DataFrame, index: DigestIndex, batches: list[tuple[str, Column | str]]) -> DataFrame:
    """The rows of docs that stay, whole: of equal texts the one with the smallest id, once."""
    kept = materialise(assign(docs, index, batches).where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("times")), "kept")
    repeated = not kept.where("times > 1").isEmpty()
    of_row, of_text = unused(docs, "own_digest", "kept_digest")
    kept_id = unused(docs, "kept_id")[0]
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("digest").alias(of_text))
    rows = docs.withColumn(of_row, digest(F.col("text")))
    same = rows[of_row].eqNullSafe(kept[of_text]) & rows["doc_id"].cast("long").eqNullSafe(kept[kept_id])
    rows = rows.join(kept.hint("merge"), same, "left_semi")
    if repeated:  # the same row more than once
        rows = rows.dropDuplicates(["doc_id", of_row])
    return rows.drop(of_row)


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the scratch folder, with a bucket for each shuffle partition, which goes when it is closed."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")), passing=True)
