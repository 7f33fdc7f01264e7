"""Incremental ingest as a stream: changed files are upserted batch by batch. An extension; the catalogue has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernweave.operators.mutations import Store


def changes(feed: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The feed(repo_id, path, checksum, ts, ...) without repeats of (repo_id, path, checksum) within the watermark."""
    return feed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["repo_id", "path", "checksum"])


def latest(batch: DataFrame) -> DataFrame:
    """The last change of each file in a batch."""
    order = Window.partitionBy("repo_id", "path").orderBy(F.desc("ts"), F.desc("checksum"))
    return batch.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def ingest(feed: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert each batch's last changes into the store's files; a batch that is run again changes nothing."""
    writer = changes(feed).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: store.upsert("files", latest(df)))
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(feed: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Changes by window and kind, for feeds with a `kind`."""
    return feed.withWatermark("ts", delay).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))
