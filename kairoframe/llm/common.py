"""What the operators share: scratch tables, column appending over Arrow, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that Python is handed at a time, as slices of Spark's batches (which Spark bounds by bytes).
ROWS = 512

_folders: list[str] = []
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names.

    Where the setting is missing, a local session (as in tests) gets a temporary folder for it; on a
    cluster, whose machines don't share one, that is an error.
    """
    base = _folders[-1] if _folders else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All scratch tables written inside are deleted at the end; what is read from them must be done by then."""
    path = scratch_path(spark, "scratch")
    _folders.append(path)
    try:
        yield
    finally:
        _folders.remove(path)
        remove(spark, path)


def materialise(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again. options: of the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options or {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what `materialise` wrote for these; nothing may read them any more."""
    for table in tables:
        if path := _written.pop(table, None):
            remove(table.sparkSession, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores put before them until no column of df has them (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """What an application over long texts sets for its session, so that Arrow batches take little memory.

    The operators don't; without it Spark's batches hold up to 10,000 rows and 64 MB.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    fields: list[T.StructField],
) -> DataFrame:
    """Append columns that Python computes batch by batch over Arrow.

    `make` runs once a task and gives the function from a record batch to the new arrays. A column
    of the same name (in any case) is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                out = apply(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(n)) for n in names] + [out[f.name] for f in fields],
                    names=names + [f.name for f in fields],
                )

    return df.mapInArrow(run, T.StructType(kept + fields))


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns; ones that are missing come as null strings."""
    have = {c.lower() for c in df.columns}
    return df.select(*[F.col(f"`{c}`") if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns])


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of edges (a, b).

    Contraction: every round each node points to its smallest neighbour if that is smaller, pointers are
    followed to the end by jumps (so a chain takes the logarithm of its length), and the links go on between
    the ends that are reached; those within one end are done, and equal ones are one. So a round's links are
    fewer than the last one's, and the rows of all rounds follow the number of links. An end that draws no
    other node in a round lies beside a smaller one in the next, so the ends halve in every two rounds.
    All steps are joins of written tables (which adaptive execution splits where a node is hot) and
    minima with partial aggregation; the driver sees one count a step, and a round's tables are deleted
    with the next. Null ends are left out.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    pairs = materialise(_ordered(pairs, "a", "b"), name)
    labels = None
    while labels is None or not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a")).toDF("node", "next")
        ups = both.groupBy("node").agg(F.min("next").alias("m")).select("node", F.least("node", "m").alias("label"))
        ups = _followed(materialise(ups, name), name)
        end_a, end_b = (ups.select(F.col("node").alias(x), F.col("label").alias(f"end_{x}")) for x in "ab")
        left = pairs.join(end_a, "a").join(end_b, "b").where("end_a <> end_b")
        left = materialise(_ordered(left, "end_a", "end_b"), name)
        if labels is None:
            after = ups
        else:
            above = ups.select(F.col("node").alias("label"), F.col("label").alias("up"))
            after = materialise(labels.join(above, "label", "left").select("node", F.coalesce("up", "label").alias("label")), name)
            release(labels, ups)
        release(pairs)
        labels, pairs = after, left
    release(pairs)
    return labels.select("node", F.col("label").alias("component"))


def _ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """The distinct pairs as (a, b), the smaller end first."""
    return pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _followed(ups: DataFrame, name: str) -> DataFrame:
    """(node, label) with labels that are nodes of smaller number or the node itself: each followed to its end."""
    while True:
        above = ups.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = ups.select("node", "label").join(above, "label").select("node", F.col("up").alias("label"), F.expr("up < label").alias("moved"))
        jumped = materialise(jumped, name)
        release(ups)
        ups = jumped
        if jumped.where("moved").isEmpty():
            return jumped
