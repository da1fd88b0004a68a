"""Tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTION_COLUMNS = ["source", "method", "unit", "item", "y_true", "y_pred"]


def bundle(root: str, **tables: DataFrame) -> None:
    """Each table into its own parquet folder under ``root``, replacing what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def predictions(df: DataFrame, path: str) -> None:
    """The predictions in a fixed column order, a folder for each source and method."""
    df.select(*PREDICTION_COLUMNS).write.mode("overwrite").partitionBy("source", "method").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def shards(treated: DataFrame, controls: DataFrame, key: str, root: str) -> None:
    """A folder for each treatment, and the controls once; ``shard`` puts them together again."""
    treated.write.mode("overwrite").partitionBy(key).parquet(f"{root}/treated")
    controls.write.mode("overwrite").parquet(f"{root}/controls")


def shard(spark, root: str, key: str, value: str) -> DataFrame:
    own = spark.read.parquet(f"{root}/treated").where(F.col(key) == value)
    return own.unionByName(spark.read.parquet(f"{root}/controls"), allowMissingColumns=True)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
