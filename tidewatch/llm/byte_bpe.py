"""Byte-level BPE through a sentencepiece model written directly from the rank file.

The model file is made field by field from the vocabulary: every byte becomes one printable character, a piece is the
characters of its bytes, its score is the negative rank (so the best-scored merge is the lowest-ranked one), and the
normaliser changes nothing. Pre-tokens are encoded one by one, so no merge crosses a boundary of the split pattern.
Decoding looks each id's piece up and maps its characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 200_000  # pre-tokens a worker remembers; a pace-maker only, results don't depend on it
SLICE_CHARS = 8 << 20  # text encoded before ids are handed on

# Bytes stand for the characters U+0100 + byte: printable, one code point each, none of them white space or a space mark.
_CHAR = [chr(0x100 + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes | str) -> bytes:
    """One protobuf field: integers as varints, floats as 32 bits, the rest with a length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the first id free is the unknown piece."""
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    if [rank for _, rank in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, _field(1, "".join(map(_CHAR.__getitem__, token))) + _field(2, -float(rank)) + _field(3, 1)) for token, rank in by_rank]
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(40, len(by_rank)))  # model_type BPE, unk_id
    plain = _field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))  # no prefix, no trimming, no escapes
    return b"".join(pieces) + unknown + trainer + plain


class _Words(dict):
    """Pre-token to its packed ids, filled as words turn up and emptied when full."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = np.array(self.merge(word.encode()), dtype="<u4").tobytes()
        return found


class Codec:
    """Encoder and decoder over one rank file and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = [bytes(ord(c) - 0x100 for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.words = _Words(self._merge)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def _merge(self, word: bytes) -> list[int]:
        # A pre-token that is itself in the vocabulary is one token, whether merges lead to it or not.
        whole = self.ranks.get(word)
        return [whole] if whole is not None else self.model.encode("".join(map(_CHAR.__getitem__, word)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(file_name: str, pattern: str) -> Codec:
    return Codec(read_ranks(SparkFiles.get(file_name)), pattern)


def _ship(df: DataFrame, ranks_path: str) -> str:
    """Give every executor the rank file, once per session; its name there."""
    context = df.sparkSession.sparkContext
    name = ranks_path.rsplit("/", 1)[-1]
    if name not in {p.rsplit("/", 1)[-1] for p in context.listFiles}:
        context.addFile(ranks_path)
    return name


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`docs` with n_tokens (long) and token_ids (binary, little-endian unsigned 32-bit) in place of columns of these names.

    Whole texts are encoded, without special tokens: what looks like one is ordinary text. Null counts as the empty
    text, which has no tokens. Rows and their other columns stay as they are, repeats and ties included.
    """
    name = _ship(docs, ranks_path)
    base = docs.select(*[c for c in docs.columns if c not in ("n_tokens", "token_ids")])
    schema = base.withColumn("n_tokens", F.lit(0).cast("long")).withColumn("token_ids", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            start, held, ids = 0, 0, []
            for i, text in enumerate(texts):
                value = text.as_py() or ""
                ids.append(codec.encode(value))
                held += len(value)
                if held >= SLICE_CHARS or i + 1 == len(texts):
                    part = batch.slice(start, i + 1 - start)
                    n = pa.array([len(x) // 4 for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([*part.columns, n, pa.array(ids, pa.binary())], names=[*part.schema.names, "n_tokens", "token_ids"])
                    start, held, ids = i + 1, 0, []

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """`encoded` with `decoded` (binary), the bytes its ids stand for. Null ids give null; an id outside the vocabulary fails."""
    name = _ship(encoded, ranks_path)
    base = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    schema = base.withColumn("decoded", F.lit(b"").cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids_col))
            start, held, out = 0, 0, []
            for i, ids in enumerate(column):
                packed = ids.as_py()
                out.append(None if packed is None else codec.decode(packed))
                held += len(packed or b"")
                if held >= SLICE_CHARS or i + 1 == len(column):
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])
                    start, held, out = i + 1, 0, []

    return base.mapInArrow(run, schema)
