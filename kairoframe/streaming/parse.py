"""Parsing over a stream: the stages keep no state, so the batch plan is the streaming plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairoframe.plans.parse import parse_df


def parse_stream(spark: SparkSession, folder: str, schema: str, reference: str) -> DataFrame:
    """A streaming DataFrame of parsed rows from a folder of Parquet files."""
    return parse_df(spark.readStream.schema(schema).parquet(folder), reference)
