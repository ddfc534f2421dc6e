"""Exact dedup by content-defined chunk recipes.

Every text is cut where its own bytes say so (a rolling hash over the last 32 bytes), which makes equal passages give
equal chunks wherever they stand. A document is then the ordered list of its chunks' identifiers, its recipe, and two
texts are equal when their recipes are. The text is read in place and only two things move: each distinct chunk once,
to prove that one identifier stands for one content, and the recipes, a few dozen bytes for a typical document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Stored, keep_rows, stored, whole

WINDOW = 32  # bytes the rolling hash sees
MIN_CHUNK = 512
AVG_BITS = 11  # one cut in 2,048 bytes
MAX_CHUNK = 16_384
ID_BYTES = 16
_GEAR = np.random.default_rng(20_240_101).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: bytes, min_chunk: int = MIN_CHUNK, avg_bits: int = AVG_BITS, max_chunk: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of one text, the last one being its length; none for an empty text."""
    n = len(data)
    if n <= min_chunk:
        return [n] if n else []
    # h[i] = sum of gear[data[i - j]] << j over the window, built by doubling the window five times.
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - avg_bits)) == 0) + 1
    ends, start = [], 0
    for mark in marks.tolist():
        while mark - start > max_chunk:
            start += max_chunk
            ends.append(start)
        if mark - start >= max(min_chunk, WINDOW):
            start = mark
            ends.append(start)
    while n - start > max_chunk:
        start += max_chunk
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes) -> Iterator[bytes]:
    start = 0
    for end in cut_points(data):
        yield data[start:end]
        start = end


def _digest(chunk: bytes, id_bytes: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=id_bytes).digest()


def _recipes(id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[_digest(c, id_bytes) for c in chunks_of(t.as_py())] for t in batch.column("_bytes")]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_bytes"]
            names = [name for name in batch.schema.names if name != "_bytes"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, pa.list_(pa.binary()))], names=[*names, "recipe"])

    return run


def _chunks(id_bytes: int, batch_bytes: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            held = 0
            again: list[tuple[bytes, bytes]] = []  # same identifier, other content: must reach the count below
            for t in batch.column(0):
                for c in chunks_of(t.as_py()):
                    d = _digest(c, id_bytes)
                    if d not in seen:
                        seen[d] = c
                        held += len(c)
                    elif seen[d] != c:
                        again.append((d, c))
                if held >= batch_bytes:
                    yield _pairs([*seen.items(), *again])
                    seen, again, held = {}, [], 0
            yield _pairs([*seen.items(), *again])

    return run


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary())], names=["id", "content"])


def _verified_recipes(source: DataFrame, id_bytes: int) -> DataFrame:
    """(doc_id, text_sha256, recipe, row), in which one identifier stands for one chunk content.

    Every distinct chunk moves once, already merged within its task. Counting the contents of each identifier proves
    the identifiers; should two contents share one, the recipes are made anew with twice the digest.
    """
    slim = source.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), F.encode("_text", "UTF-8").alias("_bytes"))
    while id_bytes <= 64:
        rows = Stored(slim.mapInArrow(_recipes(id_bytes), "doc_id long, text_sha256 string, recipe array<binary>").withColumn("row", F.monotonically_increasing_id()), "recipes")
        contents = slim.select("_bytes").mapInArrow(_chunks(id_bytes), "id binary, content binary").groupBy("id", "content").agg(F.count("*").alias("n"))
        if contents.groupBy("id").agg(F.count("*").alias("contents")).where("contents > 1").isEmpty():
            return rows.df
        rows.drop()
        id_bytes *= 2
    raise ValueError("two different chunks share a 64-byte digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, id_bytes: int = ID_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are identical; a null text counts as the empty one, whose recipe is the empty list. Of
    equal texts the row with the largest id stays; a null id ranks below every other. A row repeated with the same id
    and text counts in `group_size` and exactly one of the repeats is kept. An empty table gives an empty result;
    other columns of `docs` are ignored. Very long texts are lists of chunks of at most 16 KB.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_text"))
    rows = _verified_recipes(source, id_bytes)
    groups = stored(
        rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")).where("group_size > 1").select("recipe", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row")),
        "groups",
    )
    # Both sides are read from files, so that a group holding a large share of the rows can be split between tasks.
    return rows.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_groups` keeps, with all their columns."""
    return keep_rows(docs, exact_groups(docs, id_col, text_col).where("kept"), id_col, text_col)
