"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is bound by
multiplying its letters' vectors, the first permuted twice and the second once (a permutation is a
rotation), and a text is the bundle (sum) of its trigrams. A language's prototype is the bundle of
its texts, each scaled to length one, less the mean of all prototypes' directions, so that what the
languages share doesn't count. A text goes to the language whose prototype it has the largest cosine
with; equal cosines go to the first name.

Texts are lower-cased; whatever isn't a letter or a mark becomes one space. A null text or one
without a letter is `und` with score 0. Texts are read whole, in slices, so long ones need no more
memory. Rows without a language or a text teach nothing; with nothing learned every text is `und`.
Repeated rows get equal results; a column named like an output is replaced.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS, append_columns, plain

DIMENSIONS = 1024
#: Cosines of unrelated vectors have a standard deviation of one by the root of the dimensions; what is
#: no nearer to a language than twice that, in a text of so many words, is taken for unlike it.
LEAST, WORDS = 2 / DIMENSIONS**0.5, 8
#: Characters that are counted at a time.
SLICE = 400_000


@lru_cache(None)
def letters() -> np.ndarray:
    """For every code point its lower case, or a space where it is no letter or mark; 0 keeps none."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point, from a counter hash of the point and the word's place."""
    x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _points(text: str) -> np.ndarray:
    """The text's letters with one space before, between and after words; empty without a letter."""
    raw = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    raw = np.concatenate(([32], raw, [32]))
    out = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))]
    return out if len(out) > 2 and any(unicodedata.category(chr(c))[0] == "L" for c in np.unique(out)) else out[:0]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of every text (one row each) and whether it has a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    has = np.zeros(len(texts), bool)
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0

    def count() -> None:
        nonlocal size
        if not waiting:
            return
        rows = np.concatenate([np.full(len(p), i, np.int64) for i, p in waiting])
        points, local = np.unique(np.concatenate([p for _, p in waiting]), return_inverse=True)
        k = len(points)
        inside = (rows[2:] == rows[:-2]) & np.concatenate([_marks(len(p)) for _, p in waiting])[2:]
        grams = ((local[:-2] * k + local[1:-1]) * k + local[2:])[inside]
        first = waiting[0][0]
        span = waiting[-1][0] - first + 1
        kinds, gram = np.unique(grams, return_inverse=True)
        cells, counts = np.unique((rows[2:][inside] - first) * len(kinds) + gram, return_counts=True)
        vectors = letter_vectors(points)
        once, twice = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
        column = cells % max(1, len(kinds))
        order = np.argsort(column, kind="stable")
        for at in range(0, len(kinds), 4096):
            part = kinds[at : at + 4096]
            bound = (twice[part // (k * k)] * once[part // k % k] * vectors[part % k]).astype(np.float32)
            lo, hi = np.searchsorted(column[order], [at, at + len(part)])
            own = order[lo:hi]
            table = np.zeros((span, len(part)), np.float32)
            table[cells[own] // len(kinds), column[own] - at] = counts[own]
            out[first : first + span] += table @ bound
        waiting.clear()
        size = 0

    for i, text in enumerate(texts):
        points = _points(text or "")
        has[i] = len(points) > 0
        for at in range(0, max(0, len(points) - 2), SLICE):
            waiting.append((i, points[at : at + SLICE + 2]))
            size += len(waiting[-1][1])
            if size >= SLICE:
                count()
    count()
    return out, has


def _marks(length: int) -> np.ndarray:
    """False for the first two of a slice, where no trigram of it ends."""
    out = np.ones(length, bool)
    out[:2] = False
    return out


def learn(labelled: DataFrame, sample: int = 4_000) -> dict[str, np.ndarray]:
    """Prototypes from rows (doc_id, text, lang): one sum of vectors a language reaches the driver.

    About `sample` texts of a language are learned from at most, chosen by a hash of their ids.
    """
    rows = plain(labelled, "doc_id", "text", "lang").where("lang is not null and text is not null")
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().collect()  # as few rows as there will be prototypes
    if not counts:
        return {}
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 20, (sample << 20) // r["count"]))])
    share = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20))
    chosen = rows.where(share < rates[F.col("lang")]).select("lang", "text")

    def sums(frames):
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at : at + ROWS]
                found, has = bundles(part["text"].tolist())
                found = found[has] / np.linalg.norm(found[has], axis=1, keepdims=True).clip(1e-9)
                names = part["lang"].to_numpy()[has]
                for name in np.unique(names.astype(str)) if len(names) else ():
                    total[name] = total.get(name, 0) + found[names == name].sum(axis=0, dtype=np.float64)
        for name, vector in total.items():
            yield pd.DataFrame({"lang": name, "at": np.arange(DIMENSIONS), "x": vector})

    added = chosen.mapInPandas(sums, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    vectors = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x").orderBy("lang").collect()
    return {r["lang"]: np.round(np.array(r["x"]), 6) for r in vectors}


def identify(df: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """Append lang_pred, score, the cosine with its prototype, and likeness, the largest cosine with a bundle of a language
    before what languages share was taken off (both 0 where they are negative)."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / max(1e-9, np.linalg.norm(prototypes[n])) for n in names]).reshape(len(names), DIMENSIONS)
    raw = matrix
    if len(names) > 1:
        centred = matrix - matrix.mean(axis=0)
        matrix = centred / np.linalg.norm(centred, axis=1, keepdims=True).clip(1e-9)
    shared = df.sparkSession.sparkContext.broadcast((matrix.astype(np.float32), raw.astype(np.float32)))

    def make():
        known, bundled = shared.value

        def apply(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found, has = bundles(batch.column(batch.schema.get_field_index("text")).to_pylist())
            has &= len(names) > 0
            found /= np.linalg.norm(found, axis=1, keepdims=True).clip(1e-9)
            cosine, like = (found @ m.T if len(names) else np.zeros((len(has), 1)) for m in (known, bundled))
            best = cosine.argmax(axis=1)
            score = np.where(has, cosine[np.arange(len(best)), best].clip(0, 1), 0.0) if len(best) else np.zeros(0)
            return {
                "lang_pred": pa.array([names[b] if h else "und" for b, h in zip(best, has, strict=True)], pa.string()),
                "score": pa.array(score.astype(np.float64), pa.float64()),
                "likeness": pa.array(np.where(has, like.max(axis=1, initial=0), 0).astype(np.float64), pa.float64()),
            }

        return apply

    return append_columns(df, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("likeness", T.DoubleType())])


def accepted(text: str = "text", least: float = LEAST, words: int = WORDS) -> Column:
    """Of what `identify` appends: has the text a letter, and is it like a learned language or too short to say?"""
    short = F.regexp_count(F.col(text).cast("string"), F.lit(r"\S+")) < words
    return (F.col("lang_pred") != "und") & ((F.col("likeness") >= least) | short)
