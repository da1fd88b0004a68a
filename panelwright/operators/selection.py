"""What a panel's predictions select: concentration on few items, hits by class, interaction by class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators.metrics import interaction_rho


def broadly_active(panel: DataFrame, share: float = 0.5) -> DataFrame:
    """(item, below): the share of units whose truth at the item is below the unit's median, of items above ``share``."""
    med = F.percentile("y_true", F.lit(0.5)).over(W.partitionBy("unit"))
    p = panel.withColumn("m", med).groupBy("item").agg(F.avg((F.col("y_true") < F.col("m")).cast("double")).alias("below"))
    return p.where(F.col("below") > share)


def chosen(panel: DataFrame, by: str) -> DataFrame:
    """(unit, item): each unit's item of the lowest ``by``, of equals the first item."""
    return panel.groupBy("unit").agg(F.min_by("item", F.struct(by, "item")).alias("item"))


def concentration(panel: DataFrame, by: str, share: float = 0.5) -> DataFrame:
    """How far the units' choices concentrate: units, distinct items, the most chosen one and its share, share of broadly active choices."""
    pick = chosen(panel, by)
    active = broadly_active(panel, share).select("item", F.lit(1).alias("active"))
    each = pick.groupBy("item").agg(F.count(F.lit(1)).alias("k")).join(active, "item", "left")
    g = each.agg(F.sum("k").alias("units"), F.count(F.lit(1)).alias("distinct_items"), F.max_by("item", F.struct("k", F.col("item"))).alias("modal_item"), F.max("k").alias("top"), F.sum(F.when(F.col("active") == 1, F.col("k")).otherwise(0)).alias("act"))
    return g.select("units", "distinct_items", "modal_item", F.round(F.col("top") / F.col("units"), 6).alias("modal_share"), F.round(F.col("act") / F.col("units"), 6).alias("active_share"))


def class_hit_rate(panel: DataFrame, classes: DataFrame, *ks: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(extra, k, hit_rate, units): units whose k lowest predictions hold an item of the truly best item's class; units whose best has none don't count."""
    keys = [*extra, "unit"]
    p = panel.join(classes, "item", "left")
    best = p.groupBy(*keys).agg(F.min_by("class", F.struct("y_true", "item")).alias("best_class")).where("best_class IS NOT NULL")
    ranked = p.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("y_pred", "item"))).where(F.col("rn") <= max(ks)).join(best, keys)
    hit = ranked.groupBy(*keys).agg(F.min(F.when(F.col("class") == F.col("best_class"), F.col("rn"))).alias("first"))
    each = hit.select(*extra, "first", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return each.groupBy(*extra, "k").agg(F.round(F.avg((F.coalesce("first", F.lit(1 << 30)) <= F.col("k")).cast("double")), 6).alias("hit_rate"), F.count(F.lit(1)).alias("units"))


def interaction_by_class(panel: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, interaction_rho, n): the interaction inside each class, the units' means taken within it."""
    return interaction_rho(panel.join(classes, "item"), "class")


def breadth(panel: DataFrame, draws: int = 20) -> DataFrame:
    """(distinct_items, modal_share) quantiles over resamples of the units: a unit enters draw b by a hash of both, half of them a time."""
    pick = chosen(panel, "y_true").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    kept = pick.where(F.conv(F.substring(F.md5(F.concat_ws(":", "b", "unit")), 1, 4), 16, 10).cast("int") % 2 == 0)
    each = kept.groupBy("b", "item").agg(F.count(F.lit(1)).alias("k")).groupBy("b").agg(F.count(F.lit(1)).alias("kinds"), (F.max("k") / F.sum("k")).alias("modal"))
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 6)
    return each.agg(q("kinds", 0.025).alias("kinds_lo"), q("kinds", 0.5).alias("kinds_mid"), q("kinds", 0.975).alias("kinds_hi"), q("modal", 0.5).alias("modal_mid"))
