"""A quality classifier of supervised subword embeddings.

Words (between white space), their character n-grams and pairs of neighbouring words are hashed to rows
of an embedding table, the pairs to rows of their own. A document is the average of the vectors of all
its features, where a pair counts like a word's n-grams together, and a softmax over it gives the class.
Table and softmax are trained together by stochastic gradient descent in numpy.

Learning reads at most `sample` labelled rows (a parameter, 4,000 by default), chosen by a hash; their
texts are read whole, on the executors, and reach the driver as counts of hashed features, which the
size of the table bounds. Rows whose label isn't 0 or 1, or whose text is null, teach nothing; a row
that occurs more than once is learned from once, rows that share an id and differ are learned from
each. With nothing learned, or one class alone, every score is that class's share (0.5 with none).

Scoring reads every text whole, in batches; a worker remembers the summed vectors of a bounded number
of words. Null and empty texts have the zero vector, whose score is what the bias alone gives. Repeated
rows get equal scores; other columns stay as they are, one named `score` (in any case) is replaced. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialise, plain

BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (2, 3, 4)
#: What a pair of words counts, as a word and its n-grams do together.
PAIR = 16
#: How much larger a table row's step is than its share of the document, up to one.
GAIN = 100
#: Words whose vectors a worker remembers; when they are more it starts anew.
MEMORY = 150_000
#: Words that are summed at a time.
SLICE = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, ends, hashes): the features of all words in order, where those of each word end, and a hash of each."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(points)) - begin[owner]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64))
        whole = np.add.reduceat(points * powers[place], begin)
        found = [(np.arange(len(words)), whole)]
        for n in GRAMS:
            last = len(points) - n + 1
            if last <= 0:
                continue
            code = np.zeros(last, np.uint64)
            for k in range(n):
                code = code * np.uint64(0x9E3779B97F4A7C15) + points[k : k + last] + np.uint64(n)
            inside = owner[:last] == owner[n - 1 :]
            found.append((owner[:last][inside], code[inside]))
        rows, codes = (np.concatenate(x) for x in zip(*found, strict=True))
        codes = mixed(codes) % np.uint64(BUCKETS)
    order = np.argsort(rows, kind="stable")
    return codes[order].astype(np.int64), np.cumsum(np.bincount(rows, minlength=len(words))), whole


def pairs(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each pair of neighbouring words, from the hashes of the words in order."""
    with np.errstate(over="ignore"):
        codes = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xD1B54A32D192ED03))
    return (codes % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text's features."""
    words = text.split()
    kinds = list(dict.fromkeys(words))
    place = {w: i for i, w in enumerate(kinds)}
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    times = np.bincount(at, minlength=len(kinds))
    counts = np.zeros(2 * BUCKETS, np.int64)
    hashes = np.zeros(len(kinds), np.uint64)
    for s in range(0, len(kinds), 5_000):
        found, ends, hashes[s : s + 5_000] = features(kinds[s : s + 5_000])
        counts += np.bincount(found, np.repeat(times[s : s + 5_000], np.diff(ends, prepend=0)), 2 * BUCKETS).astype(np.int64)
    counts += PAIR * np.bincount(pairs(hashes[at]), minlength=2 * BUCKETS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A bag as a few bytes a feature: the gaps between its buckets and the counts, compressed."""
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), counts]).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, counts = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int32), counts


@dataclass
class Model:
    table: np.ndarray  # 2 BUCKETS x WIDTH
    weights: np.ndarray  # 2 x WIDTH
    bias: np.ndarray  # 2

    @property
    def learned(self) -> bool:
        """Were there labels of both classes?"""
        return bool(self.weights.any())


def train(bags: list[bytes], labels: np.ndarray, epochs: int = 8, rate: float = 0.5, seed: int = 1) -> Model:
    """Softmax regression over averaged feature vectors, one document a step, the rate falling to 0.

    The bags stay packed, so that little memory holds them; each is unpacked for its step.
    """
    rng = np.random.default_rng(seed)
    model = Model((rng.random((2 * BUCKETS, WIDTH), dtype=np.float32) - np.float32(0.5)) / np.float32(WIDTH), np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32))
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        model.bias[:] = [0, np.log(share / (1 - share))]
        return model
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = rate * (1 - steps / total)
            steps += 1
            ids, counts = unpacked(bags[i])
            share = (counts / max(1, counts.sum())).astype(np.float32)
            hidden = share @ model.table[ids]
            logits = model.weights @ hidden + model.bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = model.weights.T @ p
            model.weights -= lr * np.outer(p, hidden)
            model.bias -= lr * 0.1 * p
            # a row's step is its share, enlarged as averages of hundreds of features move slowly
            model.table[ids] -= lr * np.minimum(GAIN * share, 1)[:, None] * back[None, :]
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4_000) -> Model:
    """A model from documents (doc_id, text) and their labels (doc_id, quality), of `sample` rows at most.

    Only ids and hashes are joined with the labels; the rows chosen are broadcast to fetch their texts.
    """
    known = plain(labels, "doc_id", "quality").where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    texts = plain(docs, "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("print", F.xxhash64("text"))
    rows = texts.select("doc_id", "print").join(known, "doc_id").distinct()
    chosen = materialise(rows.orderBy(F.xxhash64(F.lit("quality"), "doc_id", "print"), "doc_id", "print", "quality").limit(sample), "quality-sample")
    fetched = texts.join(F.broadcast(chosen), ["doc_id", "print"]).select("doc_id", "print", "quality", "text")

    def make():
        def apply(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {"bag": pa.array([packed(*bag(t)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.binary())}

        return apply

    bags = append_columns(fetched, make, [T.StructField("bag", T.BinaryType())]).drop("text").dropDuplicates(["doc_id", "print", "quality"])
    got = bags.toArrow().sort_by([("doc_id", "ascending"), ("print", "ascending"), ("quality", "ascending")])
    return train(got.column("bag").to_pylist(), got.column("quality").to_numpy().astype(np.int64))


class Scorer:
    """Scores of texts; the summed feature vectors of words are computed once while remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.hashes = np.zeros((0, WIDTH + 1), np.float32), np.zeros(0, np.uint64)

    def learn(self, words: list[str]) -> None:
        rows, hashes = [self.rows], [self.hashes]
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            buckets, ends, own = features(part)
            begin = np.concatenate(([0], ends[:-1]))
            sums = np.add.reduceat(self.model.table[buckets], begin, axis=0)
            rows.append(np.column_stack([sums, ends - begin]).astype(np.float32))
            hashes.append(own)
            for word in part:
                self.known[word] = len(self.known)
        self.rows, self.hashes = np.concatenate(rows), np.concatenate(hashes)

    def one(self, words: list[str]) -> float:
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        total = np.zeros(WIDTH + 1)
        for s in range(0, len(at), SLICE):
            total += self.rows[at[s : s + SLICE]].sum(axis=0, dtype=np.float64)
            found = pairs(self.hashes[at[s : s + SLICE + 1]])
            total[:WIDTH] += PAIR * self.model.table[found].sum(axis=0, dtype=np.float64)
            total[WIDTH] += PAIR * len(found)
        logits = self.model.weights @ (total[:WIDTH] / max(1.0, total[WIDTH])) + self.model.bias
        return 1 / (1 + np.exp(np.clip(logits[0] - logits[1], -50, 50)))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            split, chars = [], 0
            while at + len(split) < len(texts) and (not split or chars < 1_000_000):
                text = texts[at + len(split)] or ""
                split.append(text.split())
                chars += len(text)
            new = set().union(*split)
            fresh = new.difference(self.known)
            if len(self.known) + len(fresh) > MEMORY:
                self.forget()
                fresh = new
            if fresh:
                self.learn(list(fresh))
            out[at : at + len(split)] = [self.one(words) for words in split]
            at += len(split)
        return out


def score(df: DataFrame, model: Model) -> DataFrame:
    """Append score, the probability of class 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def apply(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {"score": pa.array(scorer(batch.column(batch.schema.get_field_index("text")).to_pylist()), pa.float64())}

        return apply

    return append_columns(df, make, [T.StructField("score", T.DoubleType())])
