"""Token counts from an exact length histogram.

Documents are encoded where they are read and only counted by their length, so what moves is one row per distinct length
and task. Running sums over the histogram then answer, for any context limit, how many documents fit, how many tokens
there are in all, and how many are left when every document is cut at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.byte_bpe import _codec, _ship
from tidewatch.llm.common import stored, whole

BLOCK = 1_024  # lengths whose running sums are made together


def lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents encode to each length. Null counts as the empty text, of length 0."""
    name = _ship(docs, ranks_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        seen: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0):
                n = len(codec.encode(text.as_py())) // 4
                seen[n] = seen.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(whole(text_col).alias("text")).mapInArrow(count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with its running sums, one row per length L that occurs.

    docs_longer and tokens_longer are suffix sums, over documents of more than L tokens; docs_total and tokens_total are
    over all; truncated_total is the number of tokens left when every document is cut at L; quantile is the share of
    documents of at most L tokens. Sums are made within blocks of lengths and over the blocks, never over all rows at once.
    """
    rows = stored(histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "lengths")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per block of lengths
    every = Window.partitionBy()
    blocks = blocks.select(
        "block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("docs", "tokens")], *[F.sum(c).over(every).alias(f"{c}_total") for c in ("docs", "tokens")]
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(blocks, "block").withColumn("docs_longer", F.col("docs_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    joined = joined.withColumn("tokens_longer", F.col("tokens_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)))
    return joined.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        (1 - F.col("docs_longer") / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, docs_within, tokens_total, truncated_total) for context limits, whether they occur as a length or not.

    Between two lengths nothing changes but the cut of the longer documents, so the largest length up to the limit
    answers it; below the smallest length every document is cut. An empty histogram gives no rows.
    """
    asked = F.array(*[F.lit(int(v)).cast("long") for v in dict.fromkeys(limits)])
    marks = sums.select("*", F.explode(asked).alias("limit"))
    below = F.col("n_tokens") <= F.col("limit")
    best = marks.groupBy("limit").agg(F.max_by(F.struct("n_tokens", "docs_longer", "tokens_longer"), F.when(below, F.col("n_tokens"))).alias("at"), F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"))
    longer = F.coalesce("at.docs_longer", "docs_total")
    return best.select("limit", (F.col("docs_total") - longer).alias("docs_within"), "tokens_total", (F.col("tokens_total") - F.coalesce("at.tokens_longer", "tokens_total") + longer * F.col("limit")).alias("truncated_total"))


def at_quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    asked = F.array(*[F.lit(float(v)) for v in dict.fromkeys(shares)])
    within = F.col("docs_total") - F.col("docs_longer")
    return sums.select("*", F.explode(asked).alias("share")).where(within >= F.col("share") * F.col("docs_total")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
