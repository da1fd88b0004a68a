"""Matrices in long form (sample, feature, value): normalising, scaling, scattering, projecting.

A cell that isn't stored is zero.  Empty input gives no rows; null values count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators.controls import normal


def scaled(m: DataFrame, to: float, log: bool = False) -> DataFrame:
    """Every sample's values scaled to the sum ``to``; a sum of zero counts as 1."""
    total = F.sum("value").over(W.partitionBy("sample"))
    v = F.col("value") / F.when(total == 0, 1.0).otherwise(total) * to
    return m.select("sample", "feature", (F.log1p(v) if log else v).alias("value"))


def panel_scaled(m: DataFrame, panel: DataFrame, to: float, log: bool = False) -> DataFrame:
    """Scaled over the features of ``panel`` (feature) only."""
    return scaled(m.join(panel.select("feature").distinct(), "feature", "left_semi"), to, log)


def size_factors(m: DataFrame) -> DataFrame:
    """(sample, factor): the median ratio of a sample's values to the features' geometric means, over features above zero in every sample."""
    n = m.select("sample").distinct().agg(F.count(F.lit(1)).alias("samples"))
    g = m.where("value > 0").groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.avg(F.log("value")).alias("centre"))
    full = g.crossJoin(F.broadcast(n)).where("k = samples").select("feature", "centre")
    return m.join(full, "feature").groupBy("sample").agg(F.exp(F.percentile(F.log("value") - F.col("centre"), F.lit(0.5))).alias("factor"))


def z_scored(m: DataFrame) -> DataFrame:
    """Every feature to mean 0 and population spread 1; no spread counts as 1."""
    stats = m.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return m.join(stats, "feature").select("sample", "feature", ((F.col("value") - F.col("mean")) / F.when(F.col("sd") < 1e-12, 1.0).otherwise(F.col("sd"))).alias("value"))


def scaler(train: DataFrame, floor: float) -> DataFrame:
    """(feature, mean, sd) of training rows; the spread is at least ``floor``, and 1 where that is zero."""
    g = train.groupBy("feature").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(floor)).alias("sd"))
    return g.withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))


def apply_scaler(m: DataFrame, fitted: DataFrame) -> DataFrame:
    return m.join(fitted, "feature").select("sample", "feature", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"))


def scatter(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(cell, feature, value) from (cell, ids, values): tokens without a name dropped, tokens of one feature summed."""
    t = tokens.select("cell", F.explode(F.arrays_zip("ids", "values")).alias("t")).select("cell", F.col("t.ids").alias("token"), F.col("t.values").alias("value"))
    return t.join(names, "token").groupBy("cell", "feature").agg(F.sum("value").alias("value"))


def along(m: DataFrame, keys: list[str], panel: list[str], name: str) -> DataFrame:
    """(keys, name): a vector along ``panel`` for each group of (keys, feature, value), zero where a feature is missing.

    Features become places once, by a join with the vocabulary; a group's stored cells are put in their places.
    """
    places = m.sparkSession.createDataFrame(list(enumerate(panel)), f"_at int, feature {m.schema['feature'].dataType.simpleString()}")
    n = len(panel)
    cells = m.join(F.broadcast(places), "feature").groupBy(*keys, "_at").agg(F.sum("value").alias("value"))  # a vocabulary
    g = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("c"))
    # the stored cells in their order, with as many zeros between as are missing
    gaps = F.transform("c", lambda c, i: F.concat(F.array_repeat(F.lit(0.0), (c["_at"] - F.when(i == 0, -1).otherwise(F.get("c", i - 1)["_at"]) - 1).cast("int")), F.array(c["value"].cast("double"))))
    return g.select(*keys, F.concat(F.flatten(gaps), F.array_repeat(F.lit(0.0), (F.lit(n - 1) - F.element_at("c", -1)["_at"]).cast("int"))).alias(name))


def reindexed(m: DataFrame, panel: list[str]) -> DataFrame:
    """A vector for each sample along ``panel``, zero where a feature is missing, further features left out."""
    return along(m, ["sample"], panel, "vector")


def unit_norm(v: Column) -> Column:
    """A vector divided by its length; a length of zero counts as 1."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bilinear(z: Column, g: Column) -> Column:
    """[z, g, every product of the two]."""
    return F.concat(z, g, F.flatten(F.transform(z, lambda a: F.transform(g, lambda b: a * b))))


def projected(df: DataFrame, key: str, vector: str, dim: int, out: int, seed: int) -> DataFrame:
    """Vectors of ``dim`` values to ``out`` by a matrix of hashed normals, of spread 1 / sqrt(out)."""
    grid = df.sparkSession.range(out).select(F.col("id").alias("o")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))))
    weights = grid.select("o", "i", (normal(seed, F.col("o").cast("string"), F.col("i").cast("string")) / F.sqrt(F.lit(float(out)))).alias("w"))  # dim x out rows
    rows = weights.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("row"))
    flat = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "row"))), lambda x: x["row"]).alias("rows"))
    return df.crossJoin(F.broadcast(flat)).select(key, F.transform("rows", lambda r: dot(F.col(vector), r)).alias("projection"))


def top_variance(m: DataFrame, n: int) -> DataFrame:
    """The ``n`` features of the greatest sample variance, with it."""
    return m.groupBy("feature").agg(F.var_samp("value").alias("variance")).orderBy(F.desc("variance"), "feature").limit(n)
