"""Near-duplicate embeddings by product quantisation over coarse inverted lists.

The coarse quantiser is a product of two: each half of a unit vector has its own centroids, and a list
is a pair of them, so lists grow as the square of what has to be fitted and broadcast and follow the
number of vectors up to some millions. A vector is filed in the lists that its `probes` nearest centroids
of either half make; in a list it is known by the codes of its residual in each subspace and by how
far that is from the truth. Two vectors are compared at the smallest list that both are filed in, in
three steps: distances from one vector's lookup table to the other's codes; what may lie within the
radius, given the known error, has its exact cosine taken in double precision; what reaches the
threshold is linked. As the error is known, only two vectors without a list in common can be missed.

Equal vectors with equal labels are one representative from the start, so copies are counted, not
compared. A list with more representatives than a block is cut into blocks, and the pairs of blocks
are tasks of their own: exact, with bounded memory. Each task returns counts and the links of a
spanning forest, never all its pairs.

Vectors are compared only when their labels are equal and not null and their lengths agree. Null and
empty vectors, those with null or non-finite parts and zero vectors link with nothing and are their
own component. Repeated rows are copies like any other. Vectors of floats stay floats and others are
doubles; cosines are taken in double precision. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, plain, release

SUBSPACES, CODES = 8, 64
#: Representatives of the largest label that a list has on average, and centroids of a half at most.
FILED, CENTRES = 512, 4_096
#: Representatives in a block.
BLOCK = 1_024


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster keeps its centre."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        length = (centres**2).sum(1)[None, :]
        near = np.concatenate([(length - 2 * x[s : s + 4_096] @ centres.T).argmin(1) for s in range(0, len(x), 4_096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


@dataclass
class Quantiser:
    halves: list[np.ndarray]  # two: centroids x dimensions of the half
    books: list[np.ndarray]  # per subspace: codes x its dimensions
    probes: int

    @property
    def width(self) -> int:
        return sum(h.shape[1] for h in self.halves)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        """The centroid of each list."""
        first, second = np.divmod(lists, len(self.halves[1]))
        return np.concatenate([self.halves[0][first], self.halves[1][second]], axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The lists each vector is filed in, in ascending order of number."""
        near = []
        for part, centres in zip(np.split(x, [self.halves[0].shape[1]], axis=1), self.halves, strict=True):
            far = (centres**2).sum(1)[None, :] - 2 * part @ centres.T
            near.append(np.argpartition(far, min(self.probes, len(centres)) - 1, axis=1)[:, : self.probes])
        lists = near[0][:, :, None] * len(self.halves[1]) + near[1][:, None, :]
        return np.sort(lists.reshape(len(x), -1), axis=1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the distance of what they stand for from the truth."""
        codes, error = [], np.zeros(len(residual))
        for part, book in zip(self.parts(residual), self.books, strict=True):
            far = (part**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * part @ book.T
            best = far.argmin(1)
            codes.append(best)
            error += ((part - book[best]) ** 2).sum(1)
        return np.stack(codes, axis=1).astype(np.uint8), np.sqrt(error)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Per subspace, the squared distances of each residual's part to each code."""
        return [
            np.maximum((p**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * p @ b.T, 0)
            for p, b in zip(self.parts(residual), self.books, strict=True)
        ]


def fit(vectors: DataFrame, rows: int, probes: int, sample: int = 32_768, seed: int = 1) -> Quantiser | None:
    """Quantisers from a sample of (label, embedding) by hash, of `sample` rows at most (fewer when they are longer than 64).

    The number of lists follows the rows, those of the largest label.
    """
    width = vectors.agg(F.max(F.size("embedding"))).head()[0]
    if not width:
        return None
    bound = max(256, min(sample, sample * 64 // width))
    chosen = vectors.orderBy(F.xxhash64("embedding", "label"), "embedding").select("embedding").limit(bound).toArrow().to_pandas()
    x = unit(padded(chosen["embedding"], width))
    rng = np.random.default_rng(seed)
    wanted = int(np.clip(math.sqrt(rows * probes**2 / FILED), 2, min(CENTRES, max(2, len(x) // 8))))
    halves = [kmeans(part, wanted, rng) for part in np.array_split(x, 2, axis=1)]
    model = Quantiser(halves, [], 1)
    residual = x - model.centre(model.nearest(x)[:, 0])
    books = [kmeans(p, CODES, rng) for p in np.array_split(residual[:16_384], min(SUBSPACES, width), axis=1)]
    return Quantiser(halves, books, probes)


def padded(column: pd.Series, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros (they are never compared with longer)."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def forest(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the nodes that pairs (a, b) of 0..size-1 connect."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, label[a], label[b])
        np.minimum.at(label, label[b], label[a])
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(size))
    return node, label[node]


def compare(frame: pd.DataFrame, model: Quantiser, threshold: float, own: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) in frame of the linked pairs that belong to this list."""
    vectors = unit(padded(frame["embedding"], model.width))
    residual = vectors - model.centre(np.array([own]))
    codes = np.stack(frame["codes"].map(lambda c: np.frombuffer(c, np.uint8)).tolist())
    error, filed = frame["error"].to_numpy(), np.stack(frame["filed"].tolist())
    length = frame["embedding"].map(len).to_numpy()
    side = frame["block"].to_numpy()
    left = np.flatnonzero(side == side.min())
    right = left if same else np.flatnonzero(side != side.min())
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    found = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        far = np.zeros((len(rows), len(right)))
        for table, code in zip(model.tables(residual[rows]), codes[right].T, strict=True):
            far += table[:, code]
        near = np.sqrt(far) <= radius + error[right][None, :]
        near &= length[rows][:, None] == length[right][None, :]
        if same:
            near &= rows[:, None] < right[None, :]
        r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if len(r):
            exact = vectors[rows[r]] @ vectors[right[c]].T >= threshold
            i, j = np.nonzero(exact & near[np.ix_(r, c)])
            found.append((rows[r[i]], right[c[j]]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.full(len(i), -1)
    for k in range(filed.shape[1] - 1, -1, -1):  # the smallest list that both are filed in
        shared = (filed[i, k][:, None] == filed[j]).any(1)
        first = np.where(shared, filed[i, k], first)
    return i[first == own], j[first == own]


def components(vectors: DataFrame, threshold: float = 0.98, probes: int = 2) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = plain(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    kind = rows.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = rows.withColumn("embedding", F.col("embedding").cast(kind))
    usable = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull(),
        F.lit(False),
    )
    reps = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = materialise(reps.withColumn("key", F.xxhash64("label", "embedding", "rep")), "representatives")
    largest = reps.groupBy("label").count().agg(F.max("count")).head()[0] or 0
    model = fit(reps, largest, probes)
    if model is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(model)

    def file(frames):
        model = shared.value
        for frame in frames:
            for at in range(0, len(frame), 2_000):
                part = frame.iloc[at : at + 2_000]
                x = unit(padded(part["embedding"], model.width))
                lists = model.nearest(x)
                for k in range(lists.shape[1]):
                    codes, error = model.encode(x - model.centre(lists[:, k]))
                    yield part.assign(list=lists[:, k], filed=list(lists), codes=[c.tobytes() for c in codes], error=error)

    schema = f"label string, embedding {kind}, rep long, copies long, key long, list int, filed array<int>, codes binary, error double"
    filed = materialise(reps.mapInPandas(file, schema), "filed")
    sizes = materialise(filed.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "list-sizes")
    cut = filed.join(sizes, ["label", "list"]).withColumn("block", F.pmod("key", "blocks").cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "n": []}).astype(np.int64)
        same = frame["low"].iloc[0] == frame["high"].iloc[0]
        if len(frame) < 2 or (not same and frame["block"].nunique() < 2):
            return none
        frame = frame.sort_values("key").reset_index(drop=True)
        i, j = compare(frame, shared.value, threshold, int(frame["list"].iloc[0]), bool(same))
        if not len(i):
            return none
        copies, key = frame["copies"].to_numpy(), frame["key"].to_numpy()
        counts = np.bincount(i, copies[j], len(frame)) + np.bincount(j, copies[i], len(frame))
        linked = np.flatnonzero(counts)
        node, root = forest(i, j, len(frame))
        return pd.DataFrame({"a": np.concatenate([key[linked], key[node]]), "b": np.concatenate([key[linked], key[root]]), "n": np.concatenate([counts[linked].astype(np.int64), np.zeros(len(node), np.int64)])})

    found = materialise(cells.groupBy("label", "list", "low", "high").applyInPandas(cell, "a long, b long, n long"), "links")
    release(filed, sizes)
    counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    trees = connected_components(found.where("a <> b").select("a", "b"), "vectors")
    named = materialise(reps.join(trees, reps["key"] == trees["node"], "left").select("label", "embedding", "key", "rep", "copies", F.coalesce("component", "key").alias("component")), "named")
    least = materialise(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    told = materialise(named.join(least, "component").join(counts, "key", "left").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "told")
    usual = rows.where(usable).join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usual.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
