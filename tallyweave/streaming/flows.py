"""Streams: the search log in event time, and incremental indexing of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import chunking, store


def tumbling(searches: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Searches, misses and mean time per window; works on a stream and on a table."""
    rows = searches.withWatermark("searched_at", late) if searches.isStreaming else searches
    valid = F.when((F.col("ms") >= 0) & ~F.isnan("ms"), F.col("ms"))
    return rows.groupBy(F.window("searched_at", size).alias("w")).agg(
        F.count(F.lit(1)).alias("searches"), F.count(F.when(F.col("hits") == 0, 1)).alias("empty"), F.round(F.avg(valid), 6).alias("mean_ms")
    ).select(F.col("w.start").alias("start"), "searches", "empty", "mean_ms")


def sliding(searches: DataFrame, size: str = "1 day", step: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    rows = searches.withWatermark("searched_at", late) if searches.isStreaming else searches
    return rows.groupBy(F.window("searched_at", size, step).alias("w"), "repo").agg(F.count(F.lit(1)).alias("searches")).select(F.col("w.start").alias("start"), "repo", "searches")


def sessions(searches: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of searches in a repository with no pause longer than ``gap``."""
    rows = searches.withWatermark("searched_at", late) if searches.isStreaming else searches
    return rows.groupBy(F.session_window("searched_at", gap).alias("w"), "repo").agg(F.count(F.lit(1)).alias("searches")).select("repo", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "searches")


def distinct_events(searches: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Repeated events within the watermark count once."""
    return searches.withWatermark("searched_at", late).dropDuplicatesWithinWatermark(keys) if searches.isStreaming else searches.dropDuplicates(keys)


def index_stream(changed: DataFrame, store_path: str, checkpoint: str, trigger: dict | None = None):
    """Index a stream of changed files into a chunk table.

    Each micro-batch is idempotent: chunk ids are content addresses and a batch
    that is run again finds its chunks stored. Additions are appended as a batch
    folder of their own, so readers never see half of one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = chunking.chunk_files(batch)
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(f"{store_path}/batch=*")
        except Exception as e:  # the first batch has no table to read
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = fresh.limit(0)
        store.additions(fresh, stored).write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")

    return changed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def full_pass_reason(saved: str | None, saved_markup: str | None, markup: str, dirty: bool) -> str | None:
    """Why a repository is read whole and not from its last commit; null if it is not."""
    if dirty:
        return "uncommitted changes"
    if saved is None:
        return "never indexed"
    return "formats or ignores changed" if saved_markup != markup else None


def search_log(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of parquet log files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
