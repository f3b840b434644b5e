"""Removal of repeated passages by overlapping windows of three lines.

A text's lines are what newlines part; each is compared without spaces, tabs and carriage returns
around it. Three lines in a row are hashed (MD5 of the lines joined by newlines). Of a hash that
occurs more than once over all documents the first occurrence, by document id, digest of the text and line, stays; the
lines of every later one are covered, save those that the first itself spans, covered positions merge
across windows, and all of them are removed. A window of three blank lines says nothing and is left out.

Hashes are counted with partial aggregation before anything is joined, and the join back reads two
exchanges, so a passage that a third of the documents share is split. Null texts stay null with no
lines; texts of fewer than three lines stay as they are. Rows with a null id are returned unchanged
and are nobody's first occurrence. Different texts under one id are documents of their own; equal
copies of a row keep the same lines. Columns of the same names as outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

WIDTH = 3
BLANK = " \t\r"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def print_of(text: Column) -> Column:
    """What tells apart the texts under one id."""
    return F.unhex(F.md5(text))


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, print, pos, hash) of every window that isn't blank."""
    bare = docs.where("doc_id is not null and text is not null").select("doc_id", print_of(F.col("text")).alias("print"), F.transform(lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANK))).alias("bare"))
    bare = bare.where(F.size("bare") >= WIDTH)
    joined = F.transform(F.sequence(F.lit(1), F.size("bare") - (WIDTH - 1)), lambda i: F.array_join(F.slice("bare", i, WIDTH), "\n"))
    cut = bare.select("doc_id", "print", F.posexplode(joined).alias("pos", "passage"))
    return cut.where(F.length("passage") > WIDTH - 1).select("doc_id", "print", "pos", F.unhex(F.md5("passage")).alias("hash"))


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, print, line): the positions, from 0, that are removed."""
    found = windows(docs)
    firsts = found.groupBy("hash").agg(F.min(F.struct("doc_id", "print", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(firsts.select("hash", F.col("first.doc_id").alias("first_id"), F.col("first.print").alias("first_print"), F.col("first.pos").alias("first_pos")), "passages")
    later = found.join(firsts, "hash").where("doc_id <> first_id or print <> first_print or pos <> first_pos")
    begin = F.when((F.col("doc_id") == F.col("first_id")) & (F.col("print") == F.col("first_print")), F.greatest("pos", F.col("first_pos") + WIDTH)).otherwise(F.col("pos"))
    spans = later.select("doc_id", "print", begin.alias("begin"), (F.col("pos") + WIDTH - 1).alias("last")).where("begin <= last")
    return spans.select("doc_id", "print", F.explode(F.sequence("begin", "last")).alias("line")).distinct()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Every row of docs, its text without repeated passages, with n_lines before and n_removed."""
    rows = docs.drop("n_lines", "n_removed")
    gone, gone_id, gone_print, own_print, all_lines = unused(rows, "gone", "gone_id", "gone_print", "own_print", "all_lines")
    lost = covered(docs).groupBy(F.col("doc_id").alias(gone_id), F.col("print").alias(gone_print)).agg(F.array_sort(F.collect_list("line")).alias(gone))
    lost = materialise(lost, "covered")
    rows = rows.withColumn(own_print, print_of(F.col("text")))
    rows = rows.join(lost.hint("merge"), (F.col("doc_id") == F.col(gone_id)) & (F.col(own_print) == F.col(gone_print)), "left").withColumn(all_lines, lines(F.col("text")))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
    stop = lambda i: F.coalesce(F.get(gone, i), F.size(all_lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(all_lines, start(i) + 1, stop(i) - start(i))))
    return (
        rows.withColumn("n_lines", F.coalesce(F.size(all_lines), F.lit(0)).cast("long"))
        .withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
        .withColumn("n_removed", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop(gone, gone_id, gone_print, own_print, all_lines)
    )
