"""Continuous ingest: landed files in, an append-only log of item versions out.

Every accepted change of an item is one row of the log; the newest row per address is the current
item, all earlier rows are its preserved pre-images. A micro-batch therefore reads only the narrow
key columns of the log and appends; nothing stored is ever rewritten. Output folders are named after
the batch, so a repeated batch replaces its own output instead of adding to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.ingest import accepted, classify_upsert, first_wins, normalise
from tidewatch.operators.sequence import latest_per_key
from tidewatch.session import settle

LOG_COLUMNS = ["source_id", "url_hash", "content_hash", "canonical_url", "url", "title", "author", "content", "published_at", "seq"]


def landed(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream over a folder (or glob) of landed Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drop_reseen(items: DataFrame, at: str = "published_at", overlap: str = "24 hours") -> DataFrame:
    """Addresses seen again inside the overlap write nothing. Rows later than the watermark pass on
    to the table-level upsert, which stays the authority."""
    return items.withWatermark(at, overlap).dropDuplicatesWithinWatermark(["url_hash"])


def read_log(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The version log, optionally only batches older than one; null when empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    log = spark.read.parquet(path)
    return log if before is None else log.filter(F.col("batch") < before)


def current_items(log: DataFrame) -> DataFrame:
    """Newest version per address. The first version owns ``source_id`` and ``canonical_url``."""
    order = F.struct("batch", "seq")
    newest = [c for c in LOG_COLUMNS if c not in ("url_hash", "source_id", "canonical_url")]
    return log.groupBy("url_hash").agg(
        F.min_by("source_id", order).alias("source_id"),
        F.min_by("canonical_url", order).alias("canonical_url"),
        F.max_by(F.struct(*newest), order).alias("_n"),
    ).select("url_hash", "source_id", "canonical_url", "_n.*")


def ingest_batch(batch: DataFrame, batch_id: int, log_path: str, report_path: str) -> None:
    """One micro-batch: normalise, first-wins dedupe, upsert against the log, append."""
    spark = batch.sparkSession
    items = settle(accepted(normalise(batch)))
    kept = first_wins(items, "seq")
    log = read_log(spark, log_path, before=batch_id)
    if log is None:
        stored = kept.select("url_hash", "content_hash").limit(0)
    else:
        stored = latest_per_key(
            log.select("url_hash", "content_hash", "batch", "seq"), ["url_hash"], [F.col("batch"), F.col("seq")]
        ).select("url_hash", "content_hash")
    classified = settle(classify_upsert(stored, kept))
    report = classified.groupBy("source_id", "status").agg(F.count("*").alias("n"))
    report.write.mode("overwrite").parquet(f"{report_path}/batch={batch_id}")
    fresh = classified.filter("status in ('inserted', 'revised')").select(*LOG_COLUMNS)
    fresh.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")


def start_ingest(items: DataFrame, log_path: str, report_path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has landed, then stop (one scheduled pass)."""
    return (
        items.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, log_path, report_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
