"""Byte-level BPE encoding and decoding over Arrow batches.

Texts are split by the vocabulary's pattern; each distinct piece of a batch is encoded once by the
tokenizers library, over one character for each byte, and remembered in a bounded dictionary.
Decoding turns ids into their tokens' characters and these, by the reversed table, into bytes; where ids
cut a character its bytes make U+FFFD. Nulls are encoded as empty texts, empty texts give no ids. Rows are independent of each other, so
repeated rows, ties and extra columns change nothing; a column named like an output is replaced.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from .common import append_columns

#: Pieces in a worker's younger dictionary (the older one holds as many).
MEMORY = 400_000


@lru_cache(None)
def byte_characters() -> dict[int, str]:
    """One visible character for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(None)
def character_bytes() -> dict[str, int]:
    return {c: b for b, c in byte_characters().items()}


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(4)
def vocabulary(path: str) -> dict[str, int]:
    """The tokens of the file as characters, one for each byte, with their ids."""
    table = byte_characters()
    return {"".join(map(table.__getitem__, token)): rank for token, rank in read_ranks(path).items()}


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, by the reversed byte table; b"" for ids that the file leaves out."""
    tokens, table = vocabulary(path), character_bytes()
    out = [b""] * (max(tokens.values()) + 1)
    for token, rank in tokens.items():
        out[rank] = bytes(map(table.__getitem__, token))
    return out


def rank_tokenizer(path: str) -> Tokenizer:
    """A tokenizer that merges by the ranks of the file: the lower the rank of a pair's union, the sooner."""
    tokens = vocabulary(path)
    merges = []
    for token, _ in sorted(tokens.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            if token[:cut] in tokens and token[cut:] in tokens:
                merges.append((token[:cut], token[cut:]))
    return Tokenizer(models.BPE(vocab=tokens, merges=merges))


class Pieces(dict):
    """From a piece to its ids, as bytes; what is missing is taken from the older dictionary or merged."""

    def __init__(self, model: models.BPE, older: dict[str, bytes]):
        super().__init__()
        self.merge, self.older, self.table = model.tokenize, older, byte_characters()

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:  # the table maps Latin-1 code points, which are bytes
            latin = piece if piece.isascii() else piece.encode().decode("latin-1")
            ids = [token.id for token in self.merge(latin.translate(self.table))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[piece] = found
        return found


class PieceEncoder:
    """Texts to ids (little-endian unsigned 32-bit, as bytes), each distinct piece of the pattern once.

    Two dictionaries of bounded size remember pieces: when the younger is full it becomes the older
    one, and what later texts need of that moves back, so frequent pieces stay.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.model = tokenizer.model  # the merges alone: pieces are split and mapped here
        self.pieces = Pieces(self.model, {})
        self.split = regex.compile(PATTERN).findall

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            out.append(b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b"")
            if len(self.pieces) > MEMORY:
                self.pieces.older = {}
                self.pieces = Pieces(self.model, dict(self.pieces))
        return out


@lru_cache(4)
def rank_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(rank_tokenizer(path))


def byte_offsets(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each token starts in the text's UTF-8 bytes."""
    return np.concatenate(([0], np.cumsum(lengths[ids])[:-1])) if len(ids) else np.zeros(0, np.int64)


def character_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters; a token inside a character spans all of it."""
    first = byte_offsets(ids, lengths)
    leads = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    at = np.cumsum(leads) - 1
    return at[first], at[first + lengths[ids] - 1] + 1


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind))


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Append `ids` (array of int), and with offsets `starts` and `ends` in characters of the text."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), True))]
    if offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType(), True)) for n in ("starts", "ends")]

    def make():
        encoder = rank_encoder(ranks_path)
        lengths = np.array([len(t) for t in token_bytes(ranks_path)], np.int64)

        def apply(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in encoder(texts)]
            out = {"ids": _lists(ids, pa.int32())}
            if offsets:
                spans = [character_spans(t, i, lengths) for t, i in zip(texts, ids, strict=True)]
                out |= {"starts": _lists([s for s, _ in spans], pa.int32()), "ends": _lists([e for _, e in spans], pa.int32())}
            return out

        return apply

    return append_columns(df, make, fields)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Append `bytes` (what the ids stand for) and `decoded` (as text).

    Bytes that make no whole character, as where ids cut one, come out as U+FFFD in `decoded`; ids
    outside the vocabulary and nulls stand for nothing.
    """

    def make():
        table = token_bytes(ranks_path)
        size = len(table)

        def apply(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            raw = [b"".join([table[i] for i in ids or () if i is not None and 0 <= i < size]) for ids in rows]
            return {"bytes": pa.array(raw, pa.binary()), "decoded": pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())}

        return apply

    return append_columns(df, make, [T.StructField("bytes", T.BinaryType()), T.StructField("decoded", T.StringType())])
