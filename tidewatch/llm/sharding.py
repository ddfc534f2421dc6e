"""Sharding by extendible hashing.

A shard is a prefix of a document's hash bits. The directory starts with one empty prefix; a bucket over the byte limit
takes one more bit, and only such buckets do. Bits are handled a few at a time: documents are added up per cell of the
next bits, and a cell's shard is its shortest prefix that fits. Cells that fit at no prefix go on to the next bits.

Only expressions of DataFrames are used; a row of a few numbers moves for each document, never its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Stored, stored, whole

LIMIT_BYTES = 16 << 20
ROUND_BITS = 10
WORD_BITS = 60  # bits taken from each hash


def _bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, WORD_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, h0): bytes of the text in UTF-8, and the hash of id and text."""
    text = whole(text_col)
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), _bits(F.md5(key)).alias("h0"))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = LIMIT_BYTES, round_bits: int = ROUND_BITS) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (the prefix as a string of 0 and 1), shard_bytes, shard_docs.

    No shard holds more than `limit` bytes, except one that is a single document longer than that. Null and empty texts
    have 0 bytes. Rows that repeat an id and text share their first 60 bits and are told apart by a number of the row
    after that, so that any number of them still splits. An empty table gives an empty result; other columns are ignored.
    """
    rows = measured(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).withColumn("prefix", F.lit(""))
    live = Stored(rows, "rows")
    spread = live.df.withColumn("h1", _bits(F.md5(F.col("row").cast("string"))))
    done: list[DataFrame] = []
    depth = 0
    while True:
        word, offset = divmod(depth, WORD_BITS)
        if word > 1:
            raise ValueError("two rows share 120 bits of hash")
        take = min(round_bits, WORD_BITS - offset)
        cells = spread.withColumn("cell", F.shiftright(F.col(f"h{word}"), WORD_BITS - offset - take).bitwiseAND((1 << take) - 1))
        directory = stored(_directory(cells.groupBy("prefix", "cell").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n")), take, limit), "directory")
        # A cell is a slice of the hash space, so no cell of a round holds more than its share of the rows.
        found = cells.join(directory, ["prefix", "cell"])
        done.append(found.where("fits").select("doc_id", "n_bytes", F.concat("prefix", "suffix").alias("shard"), "shard_bytes", "shard_docs"))
        if directory.where("not fits").isEmpty():
            break
        rest = found.where("not fits").select("doc_id", "n_bytes", "h0", "row", F.concat("prefix", "suffix").alias("prefix"))
        live = Stored(rest, "rows")
        spread = live.df.withColumn("h1", _bits(F.md5(F.col("row").cast("string"))))
        depth += take
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _directory(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """(prefix, cell, suffix, fits, shard_bytes, shard_docs): the shortest run of the next bits at which the cell's bucket fits."""
    depths = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    at = cells.select("prefix", "cell", "n_bytes", "n", depths).withColumn("lead", F.expr(f"shiftright(cell, {bits} - depth)"))
    buckets = at.groupBy("prefix", "depth", "lead").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fitting = buckets.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    joined = at.select("prefix", "cell", "depth", "lead").join(fitting, ["prefix", "depth", "lead"])
    best = joined.groupBy("prefix", "cell").agg(
        F.min_by(F.struct("depth", "lead", "shard_bytes", "shard_docs", "fits"), F.when(F.col("fits"), F.col("depth")).otherwise(1_000 - F.col("depth"))).alias("b")
    )
    suffix = F.when(F.col("b.depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(b.lead), b.depth, '0')"))
    return best.select("prefix", "cell", suffix.alias("suffix"), "b.fits", "b.shard_bytes", "b.shard_docs")


def directory(assigned: DataFrame) -> DataFrame:
    """The shards of a result of `shards`, one row each: shard, n_docs, n_bytes."""
    return assigned.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
