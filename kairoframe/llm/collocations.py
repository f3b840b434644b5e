"""Phrase collocation mining by generalised suffix automata over shards of the corpus.

A-Z are lower-cased, `[.,;:!?\\x0A-\\x0D]` cut a text into pieces and `[^\\x20\\x09]+` are its words. All is
per language (null: "und"). A phrase of 2 to `longest` words that occurs `least` times or more is a
candidate.

1. Texts are encoded into shards of about `shard` words of one language: the distinct words, and their
   numbers in order with zeros between pieces. They are written once; all later passes read them.
2. A phrase can only occur `least` times if its words, its pairs and its triples of words do. Words, then
   pairs of passing words, then triples of passing pairs are counted by hash over all shards, each in one
   exchange. Hashes of pairs and triples go there in lists of five bytes a hash, by the part that they fall
   into; a task adds up one part at a time, and the parts grow in number with the corpus, not in size. Of
   those that pass, a bitmap of fixed size (`slots` bits, whatever the corpus) goes to all tasks. A collision lets something through, never keeps it out, and nothing else is decided by hash. A
   corpus with very many passing pairs fills the bitmap, which then spares less work: raise `slots` with it.
3. In a shard the longest stretches of passing triples, and the passing pairs outside of them, each distinct
   one once with how often it occurs, go into generalised suffix automata of bounded size. A state stands for the
   substrings that end at the same places; their number is summed along the suffix links from the longest
   state down. A state gives its substrings between its link's length and its own, up to `longest` words.
4. The counts are added by the phrase itself, so that they are exact: first over the shards of a task, then over
   tasks. A task hands on lists of phrases, one for each language and each of `PARTS` parts that phrases fall
   into by hash; a part's lists meet in one task, which gives each phrase once.
5. A candidate drops out when a longer one contains it as often as it occurs at all. Then one that is
   longer by one word does, so every candidate tells its suffix link (itself without its first word) and
   its counterpart without its last word how often it occurs.

A candidate's score for a cut after k words is floor(1000 a n / (l r)), in decimals of 38 digits; the
lowest cut counts, the earliest of equal ones. The first `first` candidates of each language come back.

Null and empty texts have no words. A shard holds whole documents, so one longer than a shard makes a
longer shard. Repeated rows count as often as they come; ids aren't read, nor columns besides text and
lang. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, plain

#: Words of a shard; bits of a bitmap.
SHARD, SLOTS = 1 << 18, 1 << 26
#: Parts that phrases fall into; phrases that a task keeps before it hands them on.
PARTS, KEPT = 256, 1 << 18
#: Words of the corpus to a part of the hashes, hashes that a task gathers before it hands them on.
SPREAD, HANDED = 1 << 21, 1 << 21
#: Shards have a row for each language, of up to some MB: a page a row, and groups of rows that a reader can hold.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(4 << 20)}
LOW = np.uint64(32)
#: Symbols of the stretches that go into one automaton; rows that are gathered before they are added up.
SYMBOLS, GATHERED = 1 << 16, 1 << 15
WORD, GAP, END = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[list(b".,;:!?\n\x0b\x0c\r")] = END
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and whether each is the first of a piece."""
    ended = pc.binary_join_element_wise(texts.fill_null(""), "", "\n").cast(pa.large_string())
    _, offsets, data = ended.buffers()
    ends = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    if not len(ended) or data is None:
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    text = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    kind = KIND[text]
    inside = np.concatenate([[False], kind == WORD, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = turns[::2], turns[1::2]
    pieces = np.searchsorted(np.flatnonzero(kind == END), starts)
    bounds = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    letters = LOWER[text[kind == WORD]]
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters))
    return found, np.concatenate([[True], np.diff(pieces) > 0])[: len(starts)]


def encode(shard: int):
    """Shards of (lang, text): (lang, n, vocabulary, counts, sequence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in pending.items():
                coded = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
                numbers, first = np.asarray(coded.indices).astype(np.int32), np.concatenate([p[1] for p in parts])
                sequence = np.zeros(len(numbers) + int(first.sum()), np.int32)
                sequence[np.arange(len(numbers)) + np.cumsum(first)] = numbers + 1
                counts = np.bincount(numbers, minlength=len(coded.dictionary)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang]), pa.array([len(numbers)], pa.int64()), pa.array(["\n".join(coded.dictionary.to_pylist())]),
                        pa.array([counts.tobytes()]), pa.array([sequence.tobytes()]),
                    ],
                    names=["lang", "n", "vocabulary", "counts", "sequence"],
                )
            pending.clear()
            pa.default_memory_pool().release_unused()

        for batch in batches:
            langs = batch.column(0).fill_null("und")
            for lang in langs.unique():
                found, first = words(batch.column(1).filter(pc.equal(langs, lang)))
                if len(found):
                    pending.setdefault(lang.as_py(), []).append((found, first))
                    size += len(found)
            if size >= shard:
                yield from flush()
                size = 0
        yield from flush()

    return run


def vocabulary(shard: str) -> list[str]:
    return shard.split("\n")


FIELDS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, known, counts in zip(*batch.columns, strict=True):
            names, n = vocabulary(known.as_py()), np.frombuffer(counts.as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(names)), pa.array(names, pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "f"])


def word_hashes(lang: str, known: list[str]) -> np.ndarray:
    """64 bits for each word number (from 1; none is 0)."""
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.array([0] + [xxhash.xxh3_64_intdigest(w, seed) for w in known], np.uint64)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of (lang, word)."""
    for batch in batches:
        found = [int(word_hashes(lang, [name])[1]) for lang, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], names=["gram"])


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64 bits for each two hashes in order."""
    out = first * np.uint64(0x9E3779B97F4A7C15) + second
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The bit of each hash in a bitmap, by its last 32 bits: lists of hashes keep those and a few more."""
    return (hashes.astype(np.uint32) % np.uint64(slots)).astype(np.int64)


def inside(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of these hashes are set."""
    slot = slot_of(hashes, 8 * len(bits))
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def bitmap(slots: int):
    """One bitmap of a column of hashes, compressed: while few bits are set it is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(slots // 8, np.uint8)
        for batch in batches:
            slot = slot_of(np.asarray(batch.column(0)).view(np.uint64), slots)
            np.bitwise_or.at(bits, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits, 1)])], names=["bits"])

    return run


def opened(bits: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bits), np.uint8)


def united(bitmaps: Iterator[bytes], slots: int) -> bytes:
    """What is set in any of compressed bitmaps; one at a time is open."""
    out = np.zeros(slots // 8, np.uint8)
    for bits in bitmaps:
        out |= opened(bits)
    return zlib.compress(out, 1)


def chains(lang: str, names: list[str], numbers: np.ndarray, bitmaps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of words (no bitmap), pairs of passing words (one) or triples of passing pairs (two): the place of each, and its hash.

    Places are of the first word. With a third bitmap: the places of the passing triples.
    """
    own = word_hashes(lang, names)
    places, hashes = np.flatnonzero(numbers), own[numbers[numbers > 0]]
    for size, bits in enumerate(bitmaps, 1):
        kept = inside(bits, hashes)
        places, hashes = places[kept], hashes[kept]
        if size == 3:
            break
        followed = np.zeros(len(numbers) + 1, bool)
        followed[places] = True
        longer = followed[places + 1]  # what begins one word further on has passed as well
        places, hashes = places[longer], mixed(hashes[longer], own[numbers[places[longer] + size]])
    return places, hashes


def chain_counts(bitmaps, least: int, parts: int):
    """Shards to (part, grams, times): the pairs or triples of a task, by the number of broadcast bitmaps, in lists by part.

    A gram is the last 32 bits of a hash, its part the bits before them (`parts` is a power of two). More than
    `least` times count as `least`: they pass with those alone.
    """

    def lists(pending: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, times = np.unique(np.concatenate(pending), return_counts=True)
        pending.clear()
        grams, times = found.astype(np.uint32), np.minimum(times, least).astype(np.min_scalar_type(least))
        bounds = np.searchsorted(found, np.arange(parts + 1, dtype=np.uint64) << LOW)
        full = np.flatnonzero(np.diff(bounds))
        cut = lambda values: pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), cut(grams), cut(times)], names=["part", "grams", "times"])
        pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pending, size = [opened(b.value) for b in bitmaps], [], 0
        for batch in batches:
            for lang, known, sequence in zip(*batch.columns, strict=True):
                _, hashes = chains(lang.as_py(), vocabulary(known.as_py()), np.frombuffer(sequence.as_py(), np.int32), bits)
                pending.append(hashes & np.uint64((parts << 32) - 1))
                size += len(hashes)
                if size >= HANDED:
                    yield from lists(pending)
                    size = 0
        if size:
            yield from lists(pending)

    return run


def passing(least: int):
    """The lists of one part to the grams that occur `least` times."""

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        grams, times = join("grams", np.uint32), join("times", np.min_scalar_type(least))
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        found = grams[first][np.add.reduceat(times[order], first, dtype=np.int64) >= least]
        return pa.table({"gram": found.astype(np.int64) | table.column("part")[0].as_py() << 32})

    return run


def stretches(numbers: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> dict[bytes, int]:
    """The distinct stretches of a shard with their numbers: of passing triples, and the passing pairs outside of them."""
    out: dict[bytes, int] = {}
    passes, covered = np.zeros(len(numbers) + 1, bool), np.zeros(len(numbers) + 1, bool)
    passes[triples] = covered[triples] = covered[triples + 1] = True
    alone = pairs[~covered[pairs]]
    found, times = np.unique(numbers[alone].astype(np.int64) << 32 | numbers[alone + 1], return_counts=True)
    for pair, n in zip(found.tolist(), times.tolist(), strict=True):
        out[np.array([pair >> 32, pair & 0xFFFFFFFF], np.int32).tobytes()] = n
    edges = np.flatnonzero(np.diff(np.concatenate([[0], passes.astype(np.int8), [0]])))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        key = numbers[start : stop + 2].tobytes()
        out[key] = out.get(key, 0) + 1
    return out


class SuffixAutomaton:
    """A generalised suffix automaton of weighted sequences; state 0 is the empty string."""

    def __init__(self) -> None:
        self.arcs: list[dict[int, int]] = [{}]
        self.link, self.length, self.end, self.times = [-1], [0], [-1], [0]

    def state(self, length: int, link: int, arcs: dict[int, int], end: int) -> int:
        self.arcs.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        self.times.append(0)
        return len(self.link) - 1

    def split(self, before: int, symbol: int, after: int) -> int:
        """The state of the strings that leave `before` by the symbol: `after` itself, or what is cut off it."""
        arcs, length = self.arcs, self.length[before] + 1
        if self.length[after] == length:
            return after
        cut = self.state(length, self.link[after], dict(arcs[after]), self.end[after])
        self.link[after] = cut
        while before >= 0 and arcs[before].get(symbol) == after:
            arcs[before][symbol] = cut
            before = self.link[before]
        return cut

    def add(self, sequence: list[int], at: int, weight: int) -> None:
        """Insert a sequence whose symbols lie from `at` on, `weight` times."""
        arcs, link, length, times = self.arcs, self.link, self.length, self.times
        last = 0
        for place, symbol in enumerate(sequence, at):
            known = arcs[last].get(symbol)
            if known is not None:
                last = self.split(last, symbol, known)
            else:
                new = self.state(length[last] + 1, 0, {}, place)
                while last >= 0 and symbol not in arcs[last]:
                    arcs[last][symbol] = new
                    last = link[last]
                if last >= 0:
                    link[new] = self.split(last, symbol, arcs[last][symbol])
                last = new
            times[last] += weight

    def substrings(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 2 up: (length, places of a last symbol, number of occurrences) of all substrings."""
        link, length, end = np.array(self.link), np.array(self.length), np.array(self.end)
        times = self.times
        for v in np.argsort(-length, kind="stable")[:-1].tolist():
            times[self.link[v]] += times[v]
        counted, shortest = np.array(times), np.concatenate([[1], length[link[1:]] + 1])
        for size in range(2, longest + 1):
            have = (shortest <= size) & (length >= size)
            yield size, end[have], counted[have]


def added(tables: list[pa.Table]) -> pa.Table:
    """(lang, phrase, f): each phrase once, with the sum of its counts."""
    return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"}).select(FIELDS.names)


def gathered(tables: Iterator[pa.Table], most: float = float("inf")) -> Iterator[pa.Table]:
    """The same counts in few tables: each phrase once, or once in every `most` phrases."""
    pending, size, limit = [], 0, GATHERED
    for table in tables:
        pending.append(table)
        size += len(table)
        if size >= limit:
            pending = [added(pending)]
            size = len(pending[0])
            limit = max(GATHERED, 2 * size)
            if size >= most:
                yield pending.pop()
                size, limit = 0, GATHERED
    if pending:
        yield added(pending)


def portions(found: dict[bytes, int]) -> Iterator[list[tuple[bytes, int]]]:
    """Stretches with their numbers, at most so many that an automaton of them stays small."""
    out, size = [], 0
    for key, weight in found.items():
        out.append((key, weight))
        size += len(key) // 4
        if size >= SYMBOLS:
            yield out
            out, size = [], 0
    if out:
        yield out


def phrase_counts(bitmaps, longest: int):
    """Shards to (part, lang, phrases, counts): the phrases of a task, in lists by part and language."""

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        bits = [opened(b.value) for b in bitmaps]
        for batch in batches:
            for lang, known, sequence in zip(*batch.columns, strict=True):
                names, numbers = vocabulary(known.as_py()), np.frombuffer(sequence.as_py(), np.int32)
                pairs, hashes = chains(lang.as_py(), names, numbers, bits[:1])
                triples, _ = chains(lang.as_py(), names, numbers, bits)
                dictionary = pa.array(names, pa.string())
                for found in portions(stretches(numbers, pairs[inside(bits[1], hashes)], triples)):
                    automaton, at = SuffixAutomaton(), 0
                    for key, weight in found:
                        automaton.add(np.frombuffer(key, np.int32).tolist(), at, weight)
                        at += len(key) // 4
                    text = np.frombuffer(b"".join(key for key, _ in found), np.int32) - 1
                    for size, ends, times in automaton.substrings(longest):
                        columns = [dictionary.take(pa.array(text[ends - back])) for back in range(size - 1, -1, -1)]
                        phrase = pc.binary_join_element_wise(*columns, " ")
                        yield pa.table([pa.repeat(lang, len(ends)), phrase, pa.array(times.astype(np.int64))], schema=FIELDS)
            pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(found_in(batches), KEPT):
            for lang in table.column("lang").unique():
                own = table.filter(pc.equal(table.column("lang"), lang))
                phrases, times = own.column("phrase").to_pylist(), own.column("f").to_numpy()
                part = np.array([xxhash.xxh3_64_intdigest(p) % PARTS for p in phrases], np.int32)
                order = np.argsort(part, kind="stable")
                for places in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    if len(places):
                        columns = [part[places[:1]], [lang.as_py()], ["\n".join([phrases[i] for i in places.tolist()])], [times[places].tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "lang", "phrases", "counts"])

    return run


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of the lists of whole parts, each phrase once."""

    def lists() -> Iterator[pa.Table]:
        for batch in batches:
            for lang, phrases, counts in zip(*(batch.column(c) for c in ("lang", "phrases", "counts")), strict=True):
                names, f = vocabulary(phrases.as_py()), np.frombuffer(counts.as_py(), np.int64)
                yield pa.table([pa.repeat(lang, len(names)), pa.array(names, pa.string()), pa.array(f)], schema=FIELDS)

    for table in gathered(lists()):
        yield from table.to_batches(65_536)


def counts(docs: DataFrame, least: int, longest: int, shard: int, slots: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to `longest` words that occur `least` times, and (lang, n)."""
    texts = plain(docs, "lang", "text").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    shards = materialise(texts.mapInArrow(encode(shard), "lang string, n long, vocabulary string, counts binary, sequence binary"), "shards", PAGES)
    totals = materialise(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    table = "lang string, phrase string, f long"
    single = shards.select("lang", "vocabulary", "counts").mapInArrow(word_counts, table).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    single = materialise(single, "words")
    whole, bitmaps = shards.select("lang", "vocabulary", "sequence"), []
    n, parts = totals.agg(F.sum("n")).first()[0] or 0, PARTS
    while parts * SPREAD < n:
        parts *= 2
    for size in (1, 2, 3):
        if size == 1:
            grams = single.select("lang", "phrase").mapInArrow(hashed, "gram long")
        else:
            lists = whole.mapInArrow(chain_counts(list(bitmaps), least, parts), "part int, grams binary, times binary")
            grams = lists.groupBy("part").applyInArrow(passing(least), "gram long")
        found = materialise(grams, "passing").coalesce(4).mapInArrow(bitmap(slots), "bits binary").collect()
        bitmaps.append(docs.sparkSession.sparkContext.broadcast(united((r["bits"] for r in found), slots)))
    lists = whole.mapInArrow(phrase_counts(bitmaps, longest), "part int, lang string, phrases string, counts binary")
    several = lists.repartition("part").mapInArrow(sums, table).where(F.col("f") >= least)
    return materialise(single.union(several), "phrases"), totals


def mine(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2_000, shard: int = SHARD, slots: int = SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first candidates of each language, by score, then a, then phrase."""
    known, totals = counts(docs, least, longest, shard, slots)
    many = known.withColumn("parts", F.split("phrase", " ")).where(F.size("parts") > 1)
    join = lambda begin, size: F.array_join(F.slice("parts", begin, size), " ")
    longer = many.where(F.size("parts") > 2)
    told = longer.select("lang", "f", F.explode(F.array(join(F.lit(2), F.size("parts")), join(F.lit(1), F.size("parts") - 1))).alias("phrase"))
    told = told.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = many.join(told, ["lang", "phrase"], "left").where("within is null or within < f")
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    cut = cut.withColumn("head", join(F.lit(1), F.col("k"))).withColumn("tail", join(F.col("k") + 1, F.size("parts"))).drop("parts")
    cut = cut.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    cut = cut.withColumn("over", (whole("a") * whole("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", whole("l") * whole("r"))
    cut = cut.withColumn("score", F.expr("over div under"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best")).select("lang", "phrase", "best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
