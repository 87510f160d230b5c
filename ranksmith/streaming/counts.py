"""Position counts kept up to date from appended games.

Counts are sums, so a batch's counts are merged into the newest snapshot. Snapshots are numbered
by the batch that made them and a batch that is run again after a failure finds its snapshot in
place, so every game counts once. Featured games depend on a collection-wide anchor and are
recomputed from visits instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explorer

VISIT = "number int, pos_key bigint, ply int, move string, outcome string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def counts(visited: DataFrame) -> DataFrame:
    return explorer.position_counts(visited.drop("outcome"), visited.select("number", "outcome").distinct())


def follow(spark: SparkSession, source: str, out: str, checkpoint: str):
    """A query that folds new Parquet files of visits under source into snapshots under out."""

    def fold(batch: DataFrame, epoch: int) -> None:
        here = f"{out}/b{epoch:09d}"
        if _exists(batch.sparkSession, here):
            return
        new = counts(batch)
        if epoch:
            new = explorer.merge_counts(batch.sparkSession.read.parquet(f"{out}/b{epoch - 1:09d}"), new)
        new.write.mode("overwrite").parquet(here)

    stream = spark.readStream.schema(VISIT).parquet(source)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Windowed counts of a stream or table of events (ts, event_type), late ones dropped."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")
