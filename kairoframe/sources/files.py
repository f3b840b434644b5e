"""Readers and writers of the engine's fixtures and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON under a fixed schema; lines that aren't JSON come as nulls."""
    return spark.read.schema(schema).json(path)


def read_sentences(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """(id, lang, text) of tab-separated sentences, plain or bz2, of one language if named."""
    rows = spark.read.csv(path, sep="\t", schema="id long, lang string, text string", quote="", escape="")
    return rows if lang is None else rows.where(F.col("lang") == lang)


def write_corpus(df: DataFrame, path: str, family: str, signature: str | None = None) -> DataFrame:
    """Write rows as lines of JSON beside nothing else, and give the manifest: rows a family, and how many different signatures."""
    df.write.mode("overwrite").json(path)
    written = df.sparkSession.read.schema(df.schema).json(path).groupBy(family)
    return written.count() if signature is None else written.agg(F.count("*").alias("count"), F.count_distinct(signature).alias("signatures"))


def append_features(rows: DataFrame, path: str, bucket: str = "bucket") -> None:
    """Append rows of features to shards by their length bucket."""
    rows.write.mode("append").partitionBy(bucket).parquet(path)


def scan_features(spark: SparkSession, path: str, longest: int, bucket: str = "bucket") -> DataFrame:
    """The rows of the shards up to a length bucket; the others' files aren't read."""
    return spark.read.parquet(path).where(F.col(bucket) <= longest)
