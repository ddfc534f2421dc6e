"""Stretches of words that repeat with a period, four times or more, in whole documents.

Periods are searched by octave, B <= q < 2B for B = 1, 2, 4, ... A run of such a period holds at least three periods of
words that equal the one q further on, so of the boundaries at multiples of B it holds one, c, whose next 2B words recur
at c + q. A task that reads a document looks for such recurrences by fingerprints of 2B words; around them it cuts tiles
that overlap their neighbours. Tiles are dealt over the cluster by document, octave and place and solved alone: Z-functions
forward and backward from each boundary give the words that equal those q further on. Intervals of one document and period
are then stitched where they touch and kept when long enough.

Fingerprints only say where to look: equal words have equal ones, and what differs in spite of them is dropped by the
Z-functions. Words are numbered within their document, so tiles compare words, not hashes of words.

Awkward input: null counts as the empty text; texts without words have no runs. Rows with equal ids and texts are solved once
and each get the result; rows with equal ids and different texts are rows of their own; a null id is an id. Ties of the
longest run go to the smallest start, then period. A long text is cut into many tiles of at most 14 B words, at least
`TILE` of them; a text of one repeated word costs as much as any of its length. Empty tables give empty results. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_WORDS, LEAST_PERIODS = 6, 4  # a run has at least 6 words and 4 periods
TILE = 4_096  # words of a tile's own part, or 8 B where that is more
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def numbered(found: list[str]) -> np.ndarray:
    """Words as numbers, equal ones equal, in the smallest type that holds them."""
    numbers: dict[str, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in found]
    return np.array(ids, np.uint16 if len(numbers) < 1 << 16 else np.uint32)


def octaves(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(B, boundaries c where the 2B words from c on seem to recur q further on, B <= q < 2B).

    The fingerprint of 2B words comes from those of their halves. Place i is compared with one boundary, the last but
    one at or before it, so an octave costs as many comparisons as there are words.
    """
    n, size = len(ids), 1
    print_ = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
    print_ ^= print_ >> np.uint64(29)
    factor = _FACTOR
    while LEAST_PERIODS * size <= n and len(print_) > size:
        print_ = print_[:-size] * factor + print_[size:]  # of 2 * size words
        factor = factor * factor * np.uint64(3)
        places = np.arange(size, len(print_))
        c = (places // size - 1) * size
        hits = c[print_[places] == print_[c]]
        if len(hits):
            yield size, np.unique(hits)
        size *= 2


def cut(ids: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Tiles worth solving: (B, place of the first boundary, width in bytes of a word's number before the numbers).

    A tile owns the boundaries of 8 B words or `TILE`, and holds 2 B words before them and 6 B after.
    """
    with np.errstate(over="ignore"):
        for size, hits in octaves(ids):
            own = max(8 * size, TILE)
            for first in np.unique(hits // own) * own:
                piece = ids[max(0, first - 2 * size) : first + own + 6 * size]
                yield size, int(first), bytes([piece.itemsize]) + piece.tobytes()


def z_function(s: list[int]) -> list[int]:
    """For each place, how many elements from it on equal those from the beginning on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def recurring(ids: np.ndarray, size: int, before: int) -> dict[int, list[int]]:
    """For each boundary from `before` on, the periods of the octave for which its next 2B words seem to recur."""
    print_ = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
    print_ ^= print_ >> np.uint64(29)
    factor, half = _FACTOR, 1
    while half <= size:
        if len(print_) <= half:
            return {}
        print_ = print_[:-half] * factor + print_[half:]
        factor = factor * factor * np.uint64(3)
        half *= 2
    places = np.arange(before + size, len(print_))
    c = (places // size - 1) * size
    hits = print_[places] == print_[c]
    by: dict[int, list[int]] = {}
    for at, i in zip(c[hits].tolist(), places[hits].tolist(), strict=True):
        by.setdefault(at, []).append(i - at)
    return by


def solve(size: int, first: int, data: bytes) -> dict[int, list[list[int]]]:
    """By period of the octave, intervals [from, to) of places in the document whose word equals the one a period on.

    From each boundary 6 B words ahead and 2 B back are looked at; longer stretches are met again from later boundaries.
    A period that the words around a boundary hold only as a multiple of a smaller one is left out: by the theorem of Fine
    and Wilf the smaller divides it, and a run that has it for its smallest shows no smaller one in two periods.
    """
    ids = np.frombuffer(data, np.uint16 if data[0] == 2 else np.uint32, offset=1)
    before = min(first, 2 * size)
    moved = first - before
    with np.errstate(over="ignore"):
        asked_for = recurring(ids, size, before)
    found: dict[int, list[list[int]]] = {}
    for c, periods in sorted(asked_for.items()):
        if c >= before + max(8 * size, TILE):
            break
        # Where a stretch is already known three octave sizes ahead, a later boundary meets its end.
        asked = [q for q in periods if q not in found or found[q][-1][1] < c + moved + 3 * size]
        if not asked:
            continue
        forward = z_function(ids[c : c + 6 * size].tolist())
        back = min(c, 2 * size)
        window = ids[c - back : c + 2 * size].tolist()[::-1]
        backward = z_function([*window[len(window) - back :], -1, *window])
        holds = [0] * (2 * size + 1)  # for q: the longest stretch from the boundary on that has a period below q
        for p in range(1, min(2 * size, len(forward))):
            holds[p + 1] = max(holds[p], forward[p] + p)
        for q in asked:
            if forward[q] < 2 * size or holds[q] >= 2 * size + q:
                continue
            # Leftwards from c + q - 1, which is 2 B - q places into the reversed window.
            same_before = backward[back + 1 + 2 * size - q]
            start, till = c - same_before + moved, c + forward[q] + moved
            mine = found.setdefault(q, [])
            if mine and start <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], till)
            else:
                mine.append([start, till])
    return found


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, key, n_words, kept_sha256 (texts without tiles), text (texts with tiles), tiles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.list_(pa.struct([("octave", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())]))
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                plain = text.as_py()
                found = WORD.findall(plain)
                tiles = [{"octave": b, "first": at, "ids": ids} for b, at, ids in cut(numbered(found))] if len(found) >= LEAST_WORDS else []
                key = hashlib.sha256(f"{doc_id}:".encode() + plain.encode()).hexdigest()
                kept = None if tiles else hashlib.sha256(" ".join(found).encode()).hexdigest()
                for column, value in zip(out, (doc_id, key, len(found), kept, plain if tiles else None, tiles), strict=True):
                    column.append(value)
                size += sum(len(t["ids"]) for t in tiles) + len(plain) * bool(tiles)
                if size > 32 << 20:
                    yield _batch(out, batch.schema.field(0).type, tile)
                    out, size = [[], [], [], [], [], []], 0
            yield _batch(out, batch.schema.field(0).type, tile)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, key string, n_words long, kept_sha256 string, text string, tiles array<struct<octave:long,first:long,ids:binary>>"
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(read, schema)


def _batch(out: list[list], id_type: pa.DataType, tile: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.string(), pa.int64(), pa.string(), pa.string(), tile]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "key", "n_words", "kept_sha256", "text", "tiles"])


def _solved(tiles: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, octave, first, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for q, intervals in solve(octave, first, ids).items():
                    for a, b in intervals:
                        for column, value in zip(out, (key, q, a, b), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], names=["key", "period", "a", "b"])

    return tiles.select("key", "octave", "first", "ids").mapInArrow(run, "key string, period long, a long, b long")


def _stitched(pieces: DataFrame) -> DataFrame:
    """Runs (key, start, length, period) from intervals of places whose word equals the one a period on."""
    order = Window.partitionBy("key", "period").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("opens", F.when(reach >= F.col("a"), 0).otherwise(1)).withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole_ = opened.groupBy("key", "period", "part").agg(F.min("a").alias("start"), (F.max("b") - F.min("a") + F.col("period")).alias("length"))
    return whole_.where((F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_PERIODS * F.col("period"))).drop("part")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per document, one row per document with runs).

    The first: doc_id, key, n_words, kept_sha256, text, where text is null and kept_sha256 given for documents that have no
    run for certain. The second: key and `runs`, array<struct<start, period, length>> in order.
    """
    rows = stored(_rows(docs, id_col, text_col), "documents")
    tiles = rows.where(F.size("tiles") > 0).select("key", F.inline("tiles")).dropDuplicates(["key", "octave", "first"])
    found = _stitched(_solved(tiles)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    return rows.drop("tiles"), found


def longest(found: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period"))


def collapse(found: list[str], intervals: list) -> list[str]:
    """The words without those that any run holds after its first period."""
    gone = np.zeros(len(found) + 1, np.int64)
    for start, period, length in intervals:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(found, keep.tolist(), strict=True) if k]


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, runs, kept_sha256 (of the kept words joined by one space)."""
    rows, found = runs(docs, id_col, text_col)
    none = F.array().cast("array<struct<start:long,period:long,length:long>>")
    sure = rows.where("text is null").select("doc_id", none.alias("runs"), "kept_sha256")
    open_ = rows.where("text is not null").select("doc_id", "key", "text").join(found, "key", "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for text, intervals in zip(batch.column(1), batch.column(2), strict=True):
                told = [(r["start"], r["period"], r["length"]) for r in intervals.as_py()]
                digests.append(hashlib.sha256(" ".join(collapse(WORD.findall(text.as_py()), told)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.string())], names=["doc_id", "runs", "kept_sha256"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, runs array<struct<start:long,period:long,length:long>>, kept_sha256 string"
    return sure.unionByName(open_.mapInArrow(drop, schema))
