"""Relational operators with a stated order: keep-first, fallback joins, densifying, matched cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each combination of ``keys``: the first by ``order``.  Null keys are a key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def head_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """At most ``n`` rows of each group, the first by ``order``; the feature is the cap."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct non-null value, and the values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def overlap_report(df: DataFrame, key: str, source: str, name: str, sources: Sequence[str]) -> DataFrame:
    """A row for each key, a column for each source with its distinct names, sorted and joined."""
    def names(s: str) -> Column:
        return F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col(source) == s, F.col(name)))), ", "), F.lit("")).alias(s)

    return df.groupBy(key).agg(*[names(s) for s in sources])


def first_match(left: DataFrame, lookups: Sequence[tuple[DataFrame, str]], value: str, name: str) -> DataFrame:
    """The value of the first lookup, in their order, that knows the row's key; each lookup has one row a key."""
    out, cols = left, []
    for i, (look, key) in enumerate(lookups):
        out = out.join(look.select(key, F.col(value).alias(f"_{i}")), key, "left")
        cols.append(F.col(f"_{i}"))
    return out.withColumn(name, F.coalesce(*cols)).drop(*[f"_{i}" for i in range(len(lookups))])


def thick_groups(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """The rows of groups that have ``least`` rows or more."""
    thick = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(thick, list(keys), "left_semi")


def complete_cases(df: DataFrame, row: str, col: str, share: float) -> DataFrame:
    """Cells of the columns that ``share`` of the rows have, and of the rows that have all these columns."""
    rows = df.select(row).distinct().agg(F.count(F.lit(1)).alias("_rows"))
    wide = df.groupBy(col).agg(F.countDistinct(row).alias("_n")).crossJoin(F.broadcast(rows)).where(F.col("_n") >= F.floor(F.col("_rows") * share)).select(col)
    kept = df.join(wide, col, "left_semi")
    full = kept.groupBy(row).agg(F.countDistinct(col).alias("_n")).crossJoin(F.broadcast(wide.agg(F.count(F.lit(1)).alias("_cols")))).where("_n = _cols").select(row)
    return kept.join(full, row, "left_semi")


def matched_cohort(base: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """The rows of ``base`` whose key every side has."""
    for side in sides:
        base = base.join(side.select(key).distinct(), key, "left_semi")
    return base


def unpivot_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row for each measure that isn't null: ids, metric, value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in measures]))
    return df.select(*ids, pairs.alias("m")).select(*ids, "m.metric", "m.value").where("value IS NOT NULL")


def leakage_flags(design: DataFrame, units: DataFrame, items: DataFrame) -> DataFrame:
    """Flags of the rows whose unit, and whose item, a corpus knows (units: unit; items: item)."""
    u = units.select("unit").distinct().withColumn("known_unit", F.lit(True))
    i = items.select("item").distinct().withColumn("known_item", F.lit(True))
    return design.join(u, "unit", "left").join(i, "item", "left").fillna(False, ["known_unit", "known_item"])


def without_leakage(design: DataFrame, units: DataFrame, items: DataFrame, direct: bool) -> DataFrame:
    """Drops rows the corpus exposes: both sides known, or either if it was trained on the task directly."""
    f = leakage_flags(design, units, items)
    exposed = (F.col("known_unit") | F.col("known_item")) if direct else (F.col("known_unit") & F.col("known_item"))
    return f.where(~exposed).drop("known_unit", "known_item")


def leakage_profile(design: DataFrame, units: DataFrame, items: DataFrame) -> DataFrame:
    f = leakage_flags(design, units, items)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return f.agg(F.count(F.lit(1)).alias("n"), share(F.col("known_unit")).alias("unit_share"), share(F.col("known_item")).alias("item_share"), share(F.col("known_unit") & F.col("known_item")).alias("both_share"))


def merged_means(rows: DataFrame, keys: list[str], chunk: str, value: str) -> DataFrame:
    """(keys, n, mean) from sums and counts of each chunk, added up; chunks may be written apart and merged later."""
    parts = rows.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    total = parts.groupBy(*keys).agg(F.sum("_sum").alias("_sum"), F.sum("_count").alias("_count"))
    return total.select(*keys, F.col("_count").alias("n"), F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).alias("mean"))


def resolved_stems(stems: DataFrame, ids: DataFrame, further: DataFrame) -> DataFrame:
    """(stem, id): by the exact name, else with underscores as spaces, else by a further key; null where none fits.

    ``ids`` and ``further``: name, id; of several ids for a name the smallest counts.
    """
    one = ids.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"))
    more = further.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("id3"))
    s = stems.select("stem").distinct().withColumn("spaced", F.replace("stem", F.lit("_"), F.lit(" ")))
    s = s.join(one.select(F.col("name").alias("stem"), F.col("id").alias("id1")), "stem", "left")
    s = s.join(one.select(F.col("name").alias("spaced"), F.col("id").alias("id2")), "spaced", "left")
    return s.join(more.withColumnRenamed("name", "stem"), "stem", "left").select("stem", F.coalesce("id1", "id2", "id3").alias("id"))


def picked(df: DataFrame, candidates: list[str], override: str | None = None) -> str:
    """The column to use: ``override`` if given, else the first candidate that the table has."""
    for c in [override] if override else candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {[override] if override else candidates} among {df.columns}")
