"""Fold assignments as relations (unit, fold): a fold's test side is its own rows, its training side all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.ranks import dealt, with_group


def leave_key_out(df: DataFrame, key: str, unit: str = "unit", missing: str | None = None) -> DataFrame:
    """Each value of ``key`` is a fold; null values are one fold named ``missing``, or none."""
    fold = F.coalesce(F.col(key), F.lit(missing)) if missing else F.col(key)
    return df.select(F.col(unit).alias("unit"), fold.alias("fold")).where("fold IS NOT NULL").distinct()


def leave_classes_out(df: DataFrame, key: str, classes: list, unit: str = "unit") -> DataFrame:
    """(unit, fold) of the named classes alone, each a fold; a class that no row has is a KeyError."""
    folds = leave_key_out(df, key, unit).where(F.col("fold").isin(classes))
    found = {r[0] for r in folds.select("fold").distinct().collect()}  # at most the named ones
    if gone := [c for c in classes if c not in found]:
        raise KeyError(f"no unit has {key} {gone}")
    return folds


def hashed_folds(df: DataFrame, k: int, unit: str = "unit") -> DataFrame:
    """The fold by a hash of the unit: no sort and no shared state, the same in every run."""
    return df.select(F.col(unit).alias("unit")).distinct().withColumn("fold", F.conv(F.substring(F.md5(F.col("unit").cast("string")), 1, 6), 16, 10).cast("int") % k)


def stratified_folds(labels: DataFrame, k: int, seed: int) -> DataFrame:
    """Folds that spread every label; labels of fewer than ``k`` units are one label."""
    p = with_group(labels.select("unit", "label"), ["label"], n=F.count(F.lit(1)))
    p = p.withColumn("label", F.when(F.col("n") < k, F.lit("__rare__")).otherwise(F.col("label"))).groupBy("unit").agg(F.min("label").alias("label"))
    return dealt(p, ["label"], F.md5(F.concat_ws(":", F.lit(seed), "unit")), "r").select("unit", ((F.col("r") - 1) % k).alias("fold"))


def balanced_group_folds(df: DataFrame, k: int, unit: str = "unit", buckets: int = 64) -> DataFrame:
    """Whole units dealt to folds by size, to and fro, so that the folds' rows stay near each other.

    The place of a unit in the order of sizes comes from ranges of sizes and a running count over them, so the
    order is never sorted in one partition; units of one size are ranked inside their size and unit range.
    """
    sizes = df.groupBy(F.col(unit).alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    per_size = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("units"))
    cuts = per_size.approxQuantile("n", [i / buckets for i in range(1, buckets)], 0.01)
    place = F.lit(0)
    for c in sorted(set(cuts)):
        place = place + (F.col("n") > c).cast("int")
    per_size = per_size.withColumn("b", place)
    above = per_size.groupBy("b").agg(F.sum("units").alias("s"))  # at most ``buckets`` rows
    above = above.select("b", F.coalesce(F.sum("s").over(W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    inside = F.coalesce(F.sum("units").over(W.partitionBy("b").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = per_size.withColumn("i", inside).join(F.broadcast(above), "b").select("n", (F.col("o") + F.col("i")).alias("start"))
    at = (F.col("start") + F.row_number().over(W.partitionBy("n").orderBy("unit")) - 1).cast("bigint")
    lap, rest = F.floor(at / k), at % k
    return sizes.join(start, "n").withColumn("fold", F.when(lap % 2 == 0, rest).otherwise(k - 1 - rest)).select("unit", "n", "fold")


def overlapping_sides(folds: DataFrame) -> DataFrame:
    """(fold_id, both): ids that a fold lists on both sides, as written."""
    sides = folds.select("fold_id", F.explode("train_patient_ids").alias("p"), F.lit(1).alias("side")).union(folds.select("fold_id", F.explode("test_patient_ids"), F.lit(2)))
    both = sides.where("p IS NOT NULL").groupBy("fold_id", "p").agg(F.countDistinct("side").alias("k")).where("k = 2")
    return both.groupBy("fold_id").agg(F.count(F.lit(1)).alias("both"))


def fold_out_mean(df: DataFrame, folds: DataFrame, value: str = "y_true", extra: tuple[str, ...] = ()) -> DataFrame:
    """For every row, the mean of its item outside its own fold, and of all items outside it where the item has no such row; ``extra`` columns make tables of their own."""
    p = df.join(folds.select("unit", "fold"), "unit")
    by = p.groupBy(*extra, "item", "fold").agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    item = by.groupBy(*extra, "item").agg(F.sum("s").alias("ts"), F.sum("k").alias("tk"))
    fold = by.groupBy(*extra, "fold").agg(F.sum("s").alias("fs"), F.sum("k").alias("fk"))
    total = by.groupBy(*extra).agg(F.sum("s").alias("as"), F.sum("k").alias("ak"))
    out = by.join(item, [*extra, "item"]).join(fold, [*extra, "fold"])
    out = out.join(total, list(extra)) if extra else out.crossJoin(F.broadcast(total))
    mean = F.when(F.col("tk") > F.col("k"), (F.col("ts") - F.col("s")) / (F.col("tk") - F.col("k"))).otherwise((F.col("as") - F.col("fs")) / (F.col("ak") - F.col("fk")))
    return p.join(out.select(*extra, "item", "fold", mean.alias("y_base")), [*extra, "item", "fold"])
