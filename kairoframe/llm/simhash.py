"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has a bit where more than half of the XXH64 values (seed 42) of a text's word shingles
have it. The anchors are the code words of perfect binary codes side by side: two Golay codes, which
cover 23 bits each within 3, and a Hamming code, which covers 15 bits within 1 (the last 3 bits are left
to the comparison), so that there are 2^35 anchors. As the codes are perfect, a fingerprint has one home
anchor. It is sent to every anchor within the covering radius plus the threshold, where what the blocks
exceed their radius by may together be the threshold at most. Whoever lies within the threshold of a
fingerprint at home at an anchor is thus sent there. Of two such fingerprints each is sent to the
other's home, and one meeting is enough: so of the anchors that a fingerprint is sent to, those after
its own home (by number) are left out. At an anchor its visitors are compared with those at home.

Where very many are at home at one anchor (a group of near copies) the code there is refined to the finest
one, whose anchors are all 64-bit words: its covering radius is 0, and a fingerprint is sent to the words
within one bit. Two fingerprints are within two bits if and only if they meet at such a word, and at most
65 different ones do, so the work follows the number of fingerprints there and not its square.

Equal fingerprints are one row from the start. Null texts count as empty; texts without a word have
fingerprint zero and are linked like any other. Null ids are grouped but never name a component when
another id is there. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, connected_components, materialise, plain, release, unused

#: Perfect codes: (bits, radius, generator polynomial); x^11+x^10+x^6+x^5+x^4+x^2+1 is the Golay code's, x^4+x+1 the Hamming code's.
GOLAY, HAMMING = (23, 3, 0b110001110101), (15, 1, 0b10011)
#: The blocks of a 64-bit fingerprint from its low end, and those of the 46-bit ones that the pipeline's stage searches.
LONG, SHORT = (GOLAY, GOLAY, HAMMING), (GOLAY, GOLAY)
#: Fingerprints at home at an anchor beyond which the code is refined there.
CROWD = 64
#: Expected documents of a cell in which candidates are verified.
CELL = 500
#: Expected documents of a block of one fingerprint, which is held against other blocks as a whole.
BLOCK = 256
#: Searches of the pipeline's stage: by parts of a text, and by the whole of it.
PARTS, WHOLES = 18, 4
#: The searches from this one on give the first candidates, which connect most of a large group of copies.
FIRST = 14


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a whole text."""
    parts = (text or "").encode().lower().split()  # on bytes, lower and split know ASCII alone
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    counts, total = np.zeros(64, np.int64), 0
    for hashes in _hashed_runs(parts, words):
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(bits)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _hashed_runs(parts: list[bytes], words: int):
    """The big-endian hashes of all runs of so many words, some thousands at a time."""
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), 65_536):
        yield b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Append `fingerprint`, the 64 bits as a signed long."""

    def make():
        def apply(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            return {"fingerprint": pa.array(found, pa.int64())}

        return apply

    return append_columns(docs, make, [T.StructField("fingerprint", T.LongType())])


@lru_cache(None)
def syndromes(code: tuple[int, int, int]) -> np.ndarray:
    """The syndrome of every word of the code's length: its remainder by the generator."""
    bits, _, generator = code
    degree = generator.bit_length() - 1
    out = np.arange(1 << bits, dtype=np.uint32)
    for bit in range(bits - 1, degree - 1, -1):
        out = np.where(out >> bit & 1, out ^ (generator << (bit - degree)), out)
    return out.astype(np.uint16)


@lru_cache(None)
def flips(code: tuple[int, int, int], threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By excess over the radius: what to flip, by syndrome, to get to the code words that near, and which entries count."""
    bits, radius, generator = code
    kinds = 1 << (generator.bit_length() - 1)
    found: list[list[list[int]]] = [[[] for _ in range(kinds)] for _ in range(threshold + 1)]
    table = syndromes(code)
    for weight in range(radius + threshold + 1):
        for places in combinations(range(bits), weight):
            flip = sum(1 << b for b in places)
            found[max(0, weight - radius)][table[flip]].append(flip)
    out = []
    for rows in found:
        sizes = np.array([len(r) for r in rows])
        padded = np.zeros((kinds, sizes.max()), np.int64)
        for at, row in enumerate(rows):
            padded[at, : len(row)] = row
        out.append((padded, np.arange(sizes.max()) < sizes[:, None]))
    return out


def cut(values: np.ndarray, blocks: tuple) -> list[tuple[tuple[int, int, int], int, np.ndarray]]:
    """(code, shift, that part of the values) of each block."""
    out, shift = [], 0
    for code in blocks:
        out.append((code, shift, values >> shift & (1 << code[0]) - 1))
        shift += code[0]
    return out


def homes_of(values: np.ndarray, blocks: tuple = LONG) -> np.ndarray:
    """The home anchor of every fingerprint."""
    home = np.zeros(len(values), np.int64)
    for code, shift, part in cut(values, blocks):
        home |= (part ^ flips(code, 0)[0][0][:, 0][syndromes(code)[part]]) << shift
    return home


def anchors(values: np.ndarray, threshold: int, blocks: tuple = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: all that each fingerprint is sent to, its home with them."""
    reached = [(threshold, np.arange(len(values)), np.zeros(len(values), np.int64))]  # what may be exceeded yet, rows, anchors
    for code, shift, part in cut(values, blocks):
        syndrome, after = syndromes(code)[part], []
        for left, rows, at in reached:
            for excess, (flip, counts) in enumerate(flips(code, threshold)[: left + 1]):
                which, k = np.nonzero(counts[syndrome[rows]])
                own = rows[which]
                after.append((left - excess, own, at[which] | (part[own] ^ flip[syndrome[own], k]) << shift))
        reached = after
    return np.concatenate([r for _, r, _ in reached]), np.concatenate([a for _, _, a in reached])


def _homes(values: DataFrame, blocks: tuple) -> DataFrame:
    """(search, fingerprint, anchor): where every fingerprint is at home."""

    def run(frames):
        for frame in frames:
            yield frame.assign(anchor=homes_of(frame["fingerprint"].to_numpy(), blocks))

    return values.select("search", "fingerprint").mapInPandas(run, "search int, fingerprint long, anchor long")


def _sent(values: DataFrame, threshold: int, blocks: tuple) -> DataFrame:
    """(search, fingerprint, anchor) for every anchor up to its home that a fingerprint is sent to."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), 2_000):
                part, search = frame["fingerprint"].to_numpy()[at : at + 2_000], frame["search"].to_numpy()[at : at + 2_000]
                rows, found = anchors(part, threshold, blocks)
                kept = found <= homes_of(part, blocks)[rows]
                rows = rows[kept]
                yield pd.DataFrame({"search": search[rows], "fingerprint": part[rows], "anchor": found[kept]})

    return values.select("search", "fingerprint").mapInPandas(run, "search int, fingerprint long, anchor long")


def links(values: DataFrame, threshold: int = 2, star: bool = True, blocks: tuple = LONG) -> DataFrame:
    """Links (search, a, b) between different fingerprints at most `threshold` (1 or 2) bits apart that connect all such pairs.

    `values` holds distinct (search, fingerprint); fingerprints of one search alone are held against each
    other. Without `star` every pair is a link (they are bounded: a fingerprint has that many words within
    the threshold), as one needs whose links must pass something else yet, which no third fingerprint can
    stand in for. With it, those that meet at a word of the finest code are linked with the least of them.
    """
    if not 1 <= threshold <= 2:
        raise ValueError("threshold must be 1 or 2")
    apart, place = F.expr("bit_count(a ^ b)"), ["search", "anchor"]
    values = values.select(F.col("search").cast("int").alias("search"), "fingerprint")
    homes = materialise(_homes(values, blocks).withColumnRenamed("fingerprint", "a"), "homes")
    visits = materialise(_sent(values, threshold, blocks).withColumnRenamed("fingerprint", "b"), "visits")
    crowded = materialise(homes.groupBy(place).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(place), "crowded")
    near = visits.join(homes.join(crowded, place, "left_anti"), place).where(F.col("a") != F.col("b")).where(apart <= threshold)
    many = visits.join(crowded, place, "left_semi").select("search", F.col("b").alias("a")).distinct()
    width = 64 if blocks == LONG else sum(bits for bits, _, _ in blocks)
    changed = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.expr("a").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    if threshold == 1:  # to be within one bit is to be one of the other's words
        meet = many.select("search", F.col("a").alias("b"), F.explode(changed).alias("a")).join(many, ["search", "a"]).where("a < b")
    else:
        words = many.repartition("search", "a").select("search", "a", F.explode(F.concat(F.array(F.col("a")), changed)).alias("word"))
        met = words.groupBy("search", "word").agg(F.collect_list("a").alias("members")).where("size(members) > 1")
        if star:
            meet = met.select("search", F.array_min("members").alias("b"), F.explode("members").alias("a"))
        else:
            later = F.filter("members", lambda m: m < F.col("b"))
            meet = met.select("search", F.explode("members").alias("b"), "members").select("search", "b", F.explode(later).alias("a"))
        meet = meet.where(F.col("a") != F.col("b")).where(apart <= threshold)
    return near.select("search", "a", "b").union(meet.select("search", "a", "b")).distinct()


def components(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of docs."""
    small = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(fingerprints(small, words).select("doc_id", "fingerprint"), "fingerprints")
    values = materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "values")
    joined = connected_components(links(values.select(F.lit(0).alias("search"), "fingerprint"), threshold).select("a", "b"), "simhash")
    named = materialise(values.join(joined, values["fingerprint"] == joined["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")), "named")
    least = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    ids = materialise(named.join(least, "component").select("fingerprint", "component_id"), "component-ids")
    release(values, joined, named, least)
    out = rows.join(ids, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def word_bits(words: list[bytes], groups: int) -> np.ndarray:
    """64 bits a group of every word, as 0 and 1: independent fingerprints come from different groups."""
    base = np.frombuffer(b"".join([xxhash.xxh64_digest(w, 42) for w in words]), ">u8").astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for k in range(groups):
            x = (base ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            out.append(x ^ (x >> np.uint64(32)))
    return np.unpackbits(np.stack(out, axis=1).view(np.uint8), axis=1).astype(np.float32)


def sketch(text: str | None, words: int = 5) -> tuple[list[int], np.ndarray]:
    """The 46-bit fingerprints of a text's words, by search, and the distinct hashes of its shingles.

    Words count by the square root of how often they occur, so that the commonest don't make all texts
    of a language alike. Texts that differ in a few words all over have like fingerprints of the whole;
    those that differ in one passage have like ones of the part without it: so most searches split the
    text at a shingle that a hash chooses (the least one, which similar texts mostly share) and take the
    longer part.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return [0] * (PARTS + WHOLES), np.zeros(0, np.int64)
    runs = b"".join(_hashed_runs(parts, words)) if len(parts) >= words else xxhash.xxh64_digest(b" ".join(parts), 42)
    hashes = np.frombuffer(runs, ">u8").astype(np.uint64)
    kinds = list(Counter(parts))
    place = {w: i for i, w in enumerate(kinds)}
    at = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
    weights = np.zeros((PARTS + WHOLES, len(kinds)), np.float32)
    for k in range(PARTS):
        with np.errstate(over="ignore"):
            x = (hashes ^ np.uint64((k + 77) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        middle = int(x.argmin())
        end = min(middle + words, len(parts))
        weights[k] = np.bincount(at[:end] if end >= len(parts) - middle else at[middle:], minlength=len(kinds))
    weights[PARTS:] = np.bincount(at, minlength=len(kinds))
    np.sqrt(weights, out=weights)
    sums = np.zeros((PARTS + WHOLES, 64), np.float32)
    for s in range(0, len(kinds), 16_384):
        bits = word_bits(kinds[s : s + 16_384], 4)
        for g in range(4):
            sums[g::4] += weights[g::4, s : s + 16_384] @ bits[:, 64 * g : 64 * g + 64]
    bits = np.packbits(2 * sums > weights.sum(axis=1, keepdims=True), axis=1)
    found = (bits.view(">u8")[:, 0].astype(np.int64) & (1 << 46) - 1).tolist()
    return found, np.unique(hashes).view(np.int64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    runs = b"".join(_hashed_runs(parts, words)) if len(parts) >= words else xxhash.xxh64_digest(b" ".join(parts), 42)
    return np.unique(np.frombuffer(runs, ">u8").astype(np.uint64)).view(np.int64)


def parity(hashes: np.ndarray) -> bytes:
    """One bit a bucket of the set's hashes (as many buckets as hashes or up to twice that): is its count odd?"""
    size = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits(np.bincount(hashes & (size - 1), minlength=size) & 1).tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the elements in one of two sets alone, by their parities: each turns one bit at most."""
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(p, np.uint8).reshape(-1, width), axis=0).tobytes() for p in (x, y))
    return (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count()


def folded(parities: list[bytes], width: int) -> np.ndarray:
    """Parities of sets that are at least that wide, as rows of this width."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(p, np.uint8).reshape(-1, width), axis=0) for p in parities])


def least_row() -> Column:
    """The row of a group with the smallest id, a null one last, and of its texts the one with the least print."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first")


def distinct_sets(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, print, key, size) of every row, and (key, fingerprints, size, parity, doc_id, print) of every distinct set that isn't empty.

    `print` tells texts under one id apart; a set's key is a digest of it, and its id and print are those
    of a row that has it.
    """
    small = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = small.withColumn("print", F.md5(F.coalesce("text", F.lit(""))))

    def make():
        def apply(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = [sketch(t, words) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            sets = [s for _, s in found]
            return {
                "key": pa.array([xxhash.xxh128_digest(s.tobytes(), 7) for s in sets], pa.binary()),
                "fingerprints": pa.array([f for f, _ in found], pa.list_(pa.int64())),
                "size": pa.array([len(s) for s in sets], pa.int64()),
                "parity": pa.array([parity(s) for s in sets], pa.binary()),
            }

        return apply

    fields = [
        T.StructField("key", T.BinaryType()), T.StructField("fingerprints", T.ArrayType(T.LongType(), True)),
        T.StructField("size", T.LongType()), T.StructField("parity", T.BinaryType()),
    ]
    rows = materialise(append_columns(small, make, fields).select("doc_id", "print", *[f.name for f in fields]), "sketches")
    full = rows.where("size > 0")
    leasts = full.groupBy("key").agg(least_row())
    sets = full.join(leasts, "key").where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("print") == F.col("first.print")))
    sets = materialise(sets.drop("first").dropDuplicates(["key"]), "sets")
    return rows.select("doc_id", "print", "key", "size"), sets


def similar(docs: DataFrame, sets: DataFrame, words: int = 5, similarity: float = 0.8, threshold: int = 1) -> DataFrame:
    """Links (a, b) that connect the keys of sets of shingles with at least this Jaccard similarity.

    A few changed words change many shingles, and with them more bits of a shingle fingerprint than
    can be searched for. So candidates come from several fingerprints of words (see `sketch`), each
    searched by anchor points within the threshold. Sizes and parities of the sets rule out candidates
    that cannot be similar, and the similarity of the others is computed exactly. First, in some of the
    searches, the first set of each fingerprint is held against the others of it and against the first of
    the least fingerprint nearby: as many pairs as there are sets. Then, in all, the first sets of all
    linked fingerprints and of their own, and all sets of one fingerprint and of two linked ones
    (`beyond_first`), where this has left them apart. No link without the similarity; what is missed are
    pairs that no fingerprint brings within the threshold.
    """
    rows = sets.select("key", F.posexplode("fingerprints").alias("search", "fingerprint"))
    values = materialise(rows.groupBy("search", "fingerprint").agg(F.min("key").alias("least")), "values")
    linked = materialise(links(values, threshold, star=False, blocks=SHORT), "fingerprint-links")
    ordered = lambda df: df.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).where("a <> b").distinct()
    named = lambda pairs: pairs.join(values.toDF("search", "a", "key_a"), ["search", "a"]).join(values.toDF("search", "b", "key_b"), ["search", "b"]).select("key_a", "key_b")
    same = rows.join(values, ["search", "fingerprint"]).where("key <> least").select("search", F.col("least").alias("key_a"), F.col("key").alias("key_b"))
    either = linked.select("search", "a", "b").union(linked.select("search", F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("search") >= FIRST)
    nearest = either.groupBy("search", "a").agg(F.min("b").alias("b")).where("b < a")
    candidates = materialise(ordered(named(nearest).union(same.where(F.col("search") >= FIRST).select("key_a", "key_b"))), "found")
    # the common part is the smaller set at most, and similar sets differ in few elements
    set_a, set_b = (sets.select(F.col("key").alias(x), F.col("size").alias(f"size_{x}"), F.col("parity").alias(f"parity_{x}")) for x in "ab")
    most = (1 - similarity) / (1 + similarity)

    def close(frames):
        for frame in frames:
            apart = np.array([least_apart(x, y) for x, y in zip(frame["parity_a"], frame["parity_b"], strict=True)], np.int64)
            yield frame.loc[apart <= most * (frame["size_a"] + frame["size_b"]) + 1e-6, ["a", "b"]]

    def bounded(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(set_a, "a").join(set_b, "b").where(F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b"))
        return sized.select("a", "b", "size_a", "size_b", "parity_a", "parity_b").mapInPandas(close, "a binary, b binary")

    near = materialise(bounded(candidates), "candidates")
    first = materialise(verify(docs, sets, near, words, similarity), "first-links")
    labels = materialise(connected_components(first, "first-groups").toDF("key", "label"), "first-labels")
    label_a, label_b = (labels.select(F.col("key").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    rest = ordered(named(linked).union(same.select("key_a", "key_b"))).join(label_a, "a", "left").join(label_b, "b", "left")
    rest = rest.where(~F.coalesce("label_a", "a").eqNullSafe(F.coalesce("label_b", "b"))).select("a", "b")
    more = bounded(rest.join(candidates, ["a", "b"], "left_anti")).union(beyond_first(sets, linked, labels, similarity).join(candidates, ["a", "b"], "left_anti"))
    more = materialise(more.distinct(), "candidates")
    found = materialise(first.union(verify(docs, sets, more, words, similarity)), "similar-links")
    release(values, linked, candidates, near, first, labels, more)
    return found


def beyond_first(sets: DataFrame, linked: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of one fingerprint or of two linked ones that labels (key, label) leave apart and that may be similar.

    Similarity isn't transitive, so a first set that is similar to neither says nothing of two others.
    The sets of a fingerprint are cut into blocks of bounded expected size, and a task holds one block
    against another; where all have one component already, none are sent.
    """
    rows = sets.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    rows = rows.select("key", "label", "size", "parity", F.posexplode("fingerprints").alias("search", "fingerprint"))
    place = ["search", "fingerprint"]
    groups = materialise(rows.groupBy(place).agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")), "groups")
    a, b = (groups.select("search", *[F.col(c).alias(f"{c}_{x}" if c != "fingerprint" else x) for c in ("fingerprint", "n", "low", "high")]) for x in "ab")
    meets = linked.join(a, ["search", "a"]).join(b, ["search", "b"]).where("n_a * n_b > 1")
    meets = meets.where("least(low_a, low_b) < greatest(high_a, high_b)").select("search", "a", "b")
    own = groups.where("n > 2 and low < high").select("search", F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"))
    meets = materialise(meets.union(own), "meetings")
    used = meets.select("search", F.explode(F.array("a", "b")).alias("fingerprint")).distinct()
    placed = rows.join(groups.join(used, place).select(*place, "n"), place)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    blocks = materialise(placed.groupBy(*place, "block").agg(F.collect_list(F.struct("key", "label", "size", "parity")).alias("members")), "blocks")
    left, right = (blocks.select("search", F.col("fingerprint").alias(x), F.col("block").alias(f"block_{x}"), F.col("members").alias(f"members_{x}")) for x in "ab")
    met = meets.join(left, ["search", "a"]).join(right, ["search", "b"]).where("a <> b or block_a <= block_b")
    met = met.repartition("search", "a", "b", "block_a", "block_b").select((F.expr("a = b and block_a = block_b")).alias("same"), "members_a", "members_b")
    most = (1 - similarity) / (1 + similarity)

    def hold(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py()
                x, y = (batch.column(i)[row].as_py() for i in (1, 2))
                out = []
                by_width: dict[int, list[int]] = {}
                for j, other in enumerate(y):
                    by_width.setdefault(len(other["parity"]), []).append(j)
                for width, members in by_width.items():
                    at = np.array(members)
                    sizes = np.array([y[j]["size"] for j in members])
                    labels = np.array([y[j]["label"] for j in members], dtype=object)
                    tables = {w: folded([y[j]["parity"] for j in members], w) for w in {min(width, len(one["parity"])) for one in x}}
                    for i, one in enumerate(x):
                        size, own = one["size"], min(width, len(one["parity"]))
                        may = (labels != one["label"]) & (np.minimum(sizes, size) >= similarity * np.maximum(sizes, size))
                        if same:
                            may &= at > i
                        which = np.flatnonzero(may)
                        if not len(which):
                            continue
                        apart = np.bitwise_count(tables[own][which] ^ folded([one["parity"]], own)).sum(axis=1)
                        out += [tuple(sorted((one["key"], y[at[j]]["key"]))) for j in which[apart <= most * (size + sizes[which]) + 1e-6]]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return met.mapInArrow(hold, "a binary, b binary").distinct()


def verify(docs: DataFrame, sets: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the candidates (a, b) whose sets have the Jaccard similarity, computed exactly, those that connect all.

    A candidate whose ends a cell has connected already isn't computed there again.
    A set goes once to the cell where its candidates' component is, not once a pair. Cells hold a
    bounded expected number of sets: small components share them by hash, and a larger component is
    cut into blocks whose pairs are cells of their own.
    """
    components_of = connected_components(candidates, "candidate-groups").toDF("key", "component")
    sizes = components_of.groupBy("component").agg(F.count("*").alias("n"))
    sizes = materialise(sizes.withColumn("blocks", F.ceil(F.col("n") / CELL).cast("int")).drop("n"), "candidate-sizes")
    places = materialise(components_of.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")), "candidate-places")
    shared = places.count() // CELL + 1

    def cell(low, high):
        own = F.struct(F.xxhash64("component").alias("group"), low.alias("low"), high.alias("high"))
        common = F.struct(F.pmod(F.xxhash64("component"), F.lit(shared)).alias("group"), F.lit(-1).alias("low"), F.lit(-1).alias("high"))
        return F.when(F.col("blocks") == 1, common).otherwise(own)

    at = places.select(F.col("key").alias("a"), "component", "blocks", F.col("block").alias("block_a"))
    pairs = candidates.join(at, "a").join(places.select(F.col("key").alias("b"), F.col("block").alias("block_b")), "b")
    pairs = materialise(pairs.select("a", "b", cell(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("cell")), "placed")
    sent = pairs.select(F.explode(F.array("a", "b")).alias("key"), "cell").distinct()
    needed = sets.select("key", F.col("doc_id").alias("of_id"), F.col("print").alias("of_print")).join(places.select("key"), "key", "left_semi")
    texts = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.join(needed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.md5("text") == F.col("of_print"))).select("key", "text")

    def make():
        def apply(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = batch.column(batch.schema.get_field_index("text")).to_pylist()
            return {"shingles": pa.array([shingles(t, words).tobytes() for t in found], pa.binary())}

        return apply

    found = append_columns(texts, make, [T.StructField("shingles", T.BinaryType())]).select("key", "shingles")
    found = materialise(found.dropDuplicates(["key"]), "shingles")

    def judge(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known = {d: np.frombuffer(x, np.int64) for d, x in zip(own["key"], own["shingles"], strict=True)}
        kept, up = [], {d: d for d in known}

        def root(d):
            while up[d] != d:
                up[d] = d = up[up[d]]
            return d

        for a, b in zip(asked["a"], asked["b"], strict=True):
            x, y = known[a], known[b]
            if root(a) == root(b):
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= similarity * (len(x) + len(y) - common):
                kept.append((a, b))
                up[root(a)] = root(b)
        return pd.DataFrame(kept, columns=["a", "b"])

    keys = [F.col("cell.group").alias("g"), F.col("cell.low").alias("l"), F.col("cell.high").alias("h")]
    left = found.join(sent, "key").select(*keys, "key", "shingles").groupBy("g", "l", "h")
    links_ = materialise(left.cogroup(pairs.select(*keys, "a", "b").groupBy("g", "l", "h")).applyInPandas(judge, "a binary, b binary"), "verified")
    release(components_of, sizes, places, pairs, found)
    return links_


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, whole: of each group of similar documents the one with the smallest id.

    Texts with equal sets of shingles are similar; texts without a word, and null ones, are similar to
    nothing and all stay. Rows are known by id and text: of different texts under one id each is judged
    by itself, of the smallest id's texts the one with the least MD5 stays. A row that occurs more than once
    stays once. A null id loses to any other.
    """
    rows, sets = distinct_sets(docs, words)
    joined = connected_components(similar(docs, sets, words, similarity), "similar")
    placed = rows.where("size > 0").join(joined.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "print", F.coalesce("component", "key").alias("component"))
    stay = placed.groupBy("component").agg(least_row()).select("first.doc_id", "first.print")
    of_id, of_print = F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")), F.col("p.print") == F.col("s.print")
    gone = placed.select("doc_id", "print").distinct().alias("p").join(stay.alias("s"), of_id & of_print, "left_anti")
    own_id, own_print, gone_id, gone_print = unused(docs, "own_id", "own_print", "gone_id", "gone_print")
    gone = materialise(gone.toDF(gone_id, gone_print), "gone")
    marked = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_print, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    out = marked.join(gone.hint("merge"), F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(own_print) == F.col(gone_print)), "left_anti")
    if not rows.groupBy("doc_id", "print").count().where("count > 1").isEmpty():  # the same row more than once
        out = out.dropDuplicates([own_id, own_print])
    return out.drop(own_id, own_print)
