"""Embedding whitening: principal components by matrix-free block Lanczos, and rows projected on them.

Entries become integers x = floor(1024 c) + 100000. The covariance V of the x-vectors (divisor n) is
never formed: a pass over the rows multiplies it by a block of vectors, as the centred X transposed
times the centred X times the block, summed by task. The basis that the passes build is orthogonalised
in full (twice) against all of itself; a block that loses rank is a breakdown, and its place is taken
by seeded random directions outside the basis. Ritz vectors of the basis are accepted when the true
residuals |V y - e y| are below `tolerance` times the largest eigenvalue, or when the basis spans the
whole space; at `widest` columns the basis restarts from its best Ritz vectors. The trace comes from
the rows' exact deviations, and gives the explained shares.

The driver holds the basis and its image (dimensions x at most `widest` columns, two arrays) and never
a row; tasks hold one Arrow batch and one block. Partial sums, a row a task, are added up by Spark.

Rows whose vector is null or holds null or non-finite entries are dropped. A shorter vector counts as
filled up with zeros. Scaled entries beyond 2^62 are held there. Deviations are exact decimals, null
beyond 38 digits. Components whose eigenvalue is no more than rounding (1e-12 of the largest) can't be whitened
and aren't returned, so tables without rows or of equal rows give none. Repeated rows count as often as
they come; equal eigenvalues leave their components free to turn in their space. Only the id and the
vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, plain

SCALE, SHIFT, LARGEST = 1_024, 100_000, 2**62
#: Rows that are multiplied at a time.
STEP = 2_048
DECIMAL = pa.decimal128(38, 0)


def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, x, size) of the rows that stay."""
    for batch in batches:
        column = batch.column(1)
        flat, offsets = column.flatten(), np.asarray(column.offsets)
        offsets = offsets - offsets[0]
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        known = np.asarray(column.is_valid())
        stays = known & (bad[offsets[1:]] == bad[offsets[:-1]])
        kept = np.repeat(stays, np.diff(offsets))
        x = np.clip(np.floor(values[kept] * SCALE), -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT
        sizes = np.diff(offsets)[stays]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(x))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(stays)), lists], names=["vec_id", "x"])


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors get the integer of zero."""
    flat, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(sizes), width), SHIFT, np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


@dataclass
class Centre:
    """The exact means S / n, as whole parts and remainders over n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @property
    def width(self) -> int:
        return len(self.whole)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, with the large parts taken away as integers."""
        return (x - self.whole).astype(np.float64) - (self.rest / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each row the sum over dimensions of (n x - S) squared, n^2 sum y^2 - 2 n sum y r + sum r^2 with y = x - whole."""
        y, n = x - self.whole, self.n
        small = not len(y) or (float(np.abs(y).max()) ** 2 * self.width < 2**62 and float(np.abs(y).max()) * n * self.width < 2**62)
        if small:
            squares, cross = (y * y).sum(1), (y * self.rest[None, :].astype(np.int64)).sum(1)
        else:
            y = y.astype(object)
            squares, cross = (y * y).sum(1), (y * self.rest.astype(object)[None, :]).sum(1)
        tail = sum(int(r) ** 2 for r in self.rest)
        return [n * n * int(a) - 2 * n * int(b) + tail for a, b in zip(squares, cross, strict=True)]


def summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows' matrices of part(matrix), a flat array of doubles: one row a task, added up in 64 groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                piece = part(matrix(batch.column(0).slice(at, STEP), width))
                total = piece if total is None else total + piece
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch.column(0):
                piece = np.asarray(one.values)
                total = piece.copy() if total is None else total + piece
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    parts = rows.select("x").mapInArrow(run, "total array<double>")
    return np.sum([np.array(r["total"]) for r in parts.repartition(16).mapInArrow(add, "total array<double>").collect()], axis=0)


def fit_centre(rows: DataFrame) -> Centre | None:
    """Row count and exact sums; None without rows or without entries."""
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).head()
    n, width = seen["n"], seen["width"]
    if not n or not width:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                x = matrix(batch.column(0).slice(at, STEP), width)
                total = total + (x.sum(0) if np.abs(x - SHIFT).max(initial=0) < 2**50 else x.astype(object).sum(0)).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width), pa.int32()), pa.array([Decimal(int(t)) for t in total], DECIMAL)], names=["at", "total"]
        )

    sums = rows.select("x").mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()
    found = {r["at"]: int(r["total"]) for r in sums}
    whole, rest = zip(*[divmod(found[i], n) for i in range(width)], strict=True)
    return Centre(n, np.array(whole, np.int64), np.array(rest, np.int64))


def basis_of(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, floor: float) -> np.ndarray:
    """Orthonormal columns outside the basis that span the block; directions lost to rounding are drawn anew."""
    width = len(block)
    room = width - basis.shape[1]
    out = np.zeros((width, 0))
    columns = min(block.shape[1], room)
    left = block
    while out.shape[1] < columns:
        for _ in range(2):
            left = left - basis @ (basis.T @ left)
            left = left - out @ (out.T @ left)
        u, s, _ = np.linalg.svd(left, full_matrices=False)
        u = u[:, s > floor][:, : columns - out.shape[1]]
        for _ in range(2):
            u = u - basis @ (basis.T @ u) - out @ (out.T @ u)
            u = np.linalg.qr(u)[0] if u.shape[1] else u
        out = np.concatenate([out, u], axis=1)
        left, floor = rng.standard_normal((width, columns)), 1e-6  # a breakdown
    return out


def lanczos(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, block: int, widest: int, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the largest `wanted` of a symmetric operator given by its product with a block."""
    rng = np.random.default_rng(seed)
    wanted, block = min(wanted, width), min(block, width)
    widest = min(width, max(widest, wanted + 2 * block))
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    new = basis_of(rng.standard_normal((width, block)), basis, rng, 0.0)
    while True:
        product = times(new)
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, product], axis=1)
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        top, largest = turns[:, :wanted], max(values[0], 0.0)
        off = image @ top - basis @ top * values[:wanted]
        whole = basis.shape[1] == width
        if whole or (basis.shape[1] >= wanted and np.linalg.norm(off, axis=0).max() <= tolerance * largest):
            vectors = basis @ top
            return np.maximum(values[:wanted], 0.0), vectors / np.linalg.norm(vectors, axis=0)
        following = product
        if basis.shape[1] + block > widest < width:  # restart from the best Ritz vectors, whose residuals are the next block
            keep = turns[:, : wanted + block]
            following = (image @ keep - basis @ keep * values[: wanted + block])[:, :block]
            basis, image = np.linalg.qr(basis @ keep)[0], None
            image = times(basis)
        new = basis_of(following, basis, rng, 1e-14 * max(largest, 1e-300))


def whiten(vectors: DataFrame, components: int = 8, block: int = 8, widest: int = 512, tolerance: float = 1e-13, seed: int = 1) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row that stays and every component.

    Calling it runs the passes (about dimensions / `block`, fewer where the spectrum falls); the rows themselves are lazy.
    """
    spark = vectors.sparkSession
    given = plain(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialise(given.mapInArrow(integers, "vec_id long, x array<bigint>"), "integers")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    centre = fit_centre(rows)
    if centre is None:
        return spark.createDataFrame([], schema)
    n, width = centre.n, centre.width

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centre(x)
            return (y.T @ (y @ q)).ravel()

        return summed(rows, width, part).reshape(width, -1) / n

    values, axes = lanczos(times, width, components, block, widest, tolerance, seed)
    known = values > 1e-12 * max(values[0], 0.0)
    values, axes = values[known], axes[:, known]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = axes / np.sqrt(values)
    means = summed(rows, width, lambda x: (centre(x) @ scaled).sum(0)) / n

    def squares(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ scaled - means
        return (w.T @ w).ravel()

    error = float(np.abs(summed(rows, width, squares).reshape(k, k) / n - np.eye(k)).max())

    def deviate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                found = centre.deviations(matrix(batch.column(0).slice(at, STEP), width))
                yield pa.RecordBatch.from_arrays([pa.array([float(d) for d in found])], names=["deviation"])

    total = rows.select("x").mapInArrow(deviate, "deviation double").agg(F.sum("deviation")).head()[0]
    shares = [float(e) * float(n) ** 3 / total for e in values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                x = matrix(batch.column(1), width)
                rows = len(x)
                deviation = pa.array([Decimal(d) if d < 10**38 else None for d in centre.deviations(x)], DECIMAL)
                every = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n, np.int64)), deviation.take(every),
                        pa.array((centre(x) @ scaled).ravel()), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(project, schema)
