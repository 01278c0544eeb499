"""Event-time metrics of a crawl, and incremental upserts by batch. Beyond batch maintenance, with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintenance import upsert
from ..sources.versions import VersionedTables


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def crawl_metrics(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and kind; events later than the watermark are left out of closed windows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: events closer than the gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def upsert_stream(changes: DataFrame, store: VersionedTables, name: str, key: str, checkpoint: str, version: str = "version") -> StreamingQuery:
    """Applies batches of changed rows to a versioned table, one committed version for each batch.

    The store's ledger says which batches of the query are in: one that runs again changes nothing. A query with a new checkpoint
    begins again, and rows older than those stored change nothing, so that it converges on the same table. Of rows with one
    key the latest version counts. Older versions are deleted, but for the last two.
    """

    def apply(batch: DataFrame, number: int) -> None:
        source = f"{name}/{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        done = store.done(source)
        if done is not None and number <= done:
            return
        base = store.manifest()["version"]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("x")).select("x.*")
        old = store.read(name, base)
        if old is not None:
            stored = old.select(F.col(key).alias("_key"), F.col(version).alias("_version"))
            last = last.join(stored, (F.col(key) == F.col("_key")) & (F.col("_version") > F.col(version)), "left_anti")
        store.commit({name: last if old is None else upsert(old, last, key)}, (source, number), base)
        store.vacuum()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
