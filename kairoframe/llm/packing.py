"""Packing of tokenized documents into windows by Karmarkar-Karp multiway differencing.

Each document is its ids and an end id. It is cut into full windows and a rest, the rest into pieces
of a quarter window at most. The pieces are dealt by hash into groups of bounded expected size; in a
group differencing merges partial partitions, largest spread first, opposing the fullest window of
one with the emptiest of the other, which leaves near-equal windows. Where the fullest exceeds the
capacity, the group is partitioned again over more windows.

Null texts count as empty and yield their end id alone. Repeated rows are packed as often as they
occur, ties are broken by document and start. No rows in, no rows out; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import PieceEncoder
from .common import ROWS, materialise, plain

#: Expected pieces of a group, whatever the input's size.
GROUP = 2_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal int"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class DocumentEncoder:
    """Texts to ids as the tokenizers library gives them without adding special tokens.

    Texts in which one of the vocabulary's added tokens is written out (`<|endoftext|>`) go to the library
    itself, which gives that token's id; the others to the encoder that remembers pieces.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.written = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = PieceEncoder(self.tokenizer)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = self.pieces([None if self.special(t) else t for t in texts])
        for i, text in enumerate(texts):
            if self.special(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def special(self, text: str | None) -> bool:
        return bool(text) and any(token in text for token in self.written)


@lru_cache(2)
def _encoder(tokenizer_path: str) -> DocumentEncoder:
    return DocumentEncoder(tokenizer_path)


def cuts(tokens: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then pieces of a quarter window at most."""
    full = tokens - tokens % window
    piece = max(1, window // 4)
    return [(s, window) for s in range(0, full, window)] + [(s, min(piece, tokens - s)) for s in range(full, tokens, piece)]


def difference(sizes: list[int], bins: int) -> list[list[int]]:
    """Multiway differencing: the members of each bin, as positions in sizes.

    A partial partition is its bins that aren't empty, fullest first; the others count as zero. The
    two partitions of the largest spread are merged, fullest against emptiest.
    """
    heap = [(-size, i, [(size, (i, None))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        overlap = len(a) + len(b) - bins
        if overlap <= 0:
            merged = a + b
        else:  # the emptiest of both meet: a's last with b's first among the last `overlap` places
            joined = [(x + y, (m, n)) for (x, m), (y, n) in zip(a[-overlap:], reversed(b[-overlap:]), strict=True)]
            merged = a[:-overlap] + b[:-overlap] + joined
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == bins else 0)
        heapq.heappush(heap, (-spread, order, merged))
        order += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        members, todo = [], [tree]
        while todo:
            left, right = todo.pop()
            if right is None:
                members.append(left)
            else:
                todo += [left, right]
        out.append(sorted(members))
    return out


def windows(sizes: list[int], window: int) -> list[list[int]]:
    """Near-equal windows within the capacity; their number rises until the fullest fits."""
    count = -(-sum(sizes) // window)
    while True:
        found = difference(sizes, max(1, count))
        most = max((sum(sizes[i] for i in members) for members in found), default=0)
        if most <= window:
            return found
        count += max(1, count // 200)


def pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int) -> DataFrame:
    """One row for each piece of each document, with the CRC of its ids."""

    def run(batches):
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        deal = 0
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1).to_pylist()), strict=True):
                ids += end
                tokens = len(ids) // 4
                for start, length in cuts(tokens, window):
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens, deal))
                    deal = (deal + 1) % 1_000_003
            kinds = [pa.int64()] * 5 + [pa.int32()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"],
            )

    docs = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: its place in the document and in its sequence."""
    cut = materialise(pieces(docs, tokenizer_path, window, end_id), "pieces")
    groups = cut.count() // GROUP + 1
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "deal"), F.lit(groups)))

    def arrange(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32", "deal"], na_position="first").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        whole = np.flatnonzero(lengths == window)
        rest = np.flatnonzero(lengths != window)
        found = [[int(i)] for i in whole]
        found += [[int(rest[i]) for i in members] for members in windows([int(x) for x in lengths[rest]], window)]
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for number, members in enumerate(found):
            sequence[members] = number
            offset[members] = np.concatenate(([0], np.cumsum(lengths[members])[:-1]))
        frame["sequence_id"] = (frame["grp"].to_numpy() << 32) + sequence
        frame["offset"] = offset
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return dealt.groupBy("grp").applyInPandas(arrange, PACKED)
