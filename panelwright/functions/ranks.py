"""Ranks and places within keys, and over a whole table, that never sort a key's rows in one partition.

Values fall into ranges, a range is ranked on its own, and is moved by the number of rows below it; so a key that
holds a third of all rows is sorted in as many parts as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.session import checkpointed


def less_than(value: str):
    return lambda c: c < F.col(value)


def group_avg_rank(df: DataFrame, keys: Sequence[str], values: dict[str, str], buckets: int = 64) -> DataFrame:
    """Adds for each of ``values``, under the name it gives, the rank within ``keys``, from 1, tied values sharing the mean of their ranks.

    Null values get none; rows with a null key are left out.  Ranges come from approximate quantiles of the whole
    table, a row of ``buckets`` numbers that is broadcast.  Rows are counted by distinct value first, so that ties meet
    in a partial aggregate.  ``df`` is read several times: what it is made of is written once and cut off.
    """
    keys, df = list(keys), checkpointed(df)
    out = df
    for value, name in values.items():
        counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
        cuts = df.agg(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000)).alias("_cuts"))
        placed = counted.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", less_than(value)))).drop("_cuts")
        below = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"))  # at most ``buckets`` rows a key
        below = below.select(*keys, "_b", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
        upto = F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy(value))
        ranked = placed.withColumn("_u", upto).join(below, [*keys, "_b"]).select(*keys, value, (F.col("_o") + F.col("_u") - (F.col("_n") - 1) / 2.0).alias(name))
        out = out.join(ranked, [*keys, value], "left")
    return out.dropna(subset=keys)


def with_group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Adds aggregates of the ``keys`` groups, made by partial aggregates and a join, not by gathering a group's rows."""
    keys = list(keys)
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]), keys)


def dealt(df: DataFrame, keys: Sequence[str], by: Column, name: str) -> DataFrame:
    """Adds the place, from 1, of each row within ``keys`` in the order of the hex text ``by``, a hash of the row.

    Hashes spread evenly over the 256 ranges of their first two digits, each of which is sorted on its own.
    """
    keys = list(keys)
    d = df.withColumn("_h", by).withColumn("_p", F.substring("_h", 1, 2))
    n = d.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))  # at most 256 rows a key
    n = n.select(*keys, "_p", F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.row_number().over(W.partitionBy(*keys, "_p").orderBy("_h"))
    return d.withColumn("_i", inside).join(n, [*keys, "_p"]).withColumn(name, (F.col("_o") + F.col("_i")).cast("int")).drop("_h", "_p", "_i", "_o")


def leave_one_out_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the mean of the other rows of the group; null where a row is alone."""
    g = with_group(df, keys, _n=F.count(value), _t=F.sum(value))
    return g.withColumn(name, F.when(F.col("_n") > 1, (F.col("_t") - F.col(value)) / (F.col("_n") - 1))).drop("_n", "_t")


def table_avg_rank(df: DataFrame, value: str, name: str, buckets: int = 64) -> DataFrame:
    """Adds the average-tie rank of ``value`` over the whole table; null values get none."""
    return group_avg_rank(df.withColumn("_one", F.lit(1)), ["_one"], {value: name}, buckets).drop("_one")
