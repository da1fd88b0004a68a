"""The ingest layer as a stream: windowed group means that grow with arriving files, kept as the last word for each key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import shared_folder


def stream_folder(spark: SparkSession) -> str:
    """A new folder under the one all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def windowed_means(stream: DataFrame, ts: str, value: str, *keys: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, keys, n, total): rows later than ``late`` behind the newest don't count."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys)
    return g.agg(F.count(value).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def run_to_table(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream of updates over all that is there and returns each key's last update; a rerun of a batch writes the same rows."""
    spark = updates.sparkSession
    root = stream_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/part={number}")

    q = updates.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out").drop("part")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, "x.*")
