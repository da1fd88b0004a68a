"""Metrics of a panel: rows (unit, item, y_true, y_pred).  Empty panels give null metrics; ties go by the item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.ranks import group_avg_rank, table_avg_rank, with_group
from panelwright.session import checkpointed

GRID = 9  # decimals that values are rounded to before they are ranked, so that ulp dust breaks no ties


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson's correlation; null where a side has no spread."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def flat(*cols: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | (F.stddev_pop(c) < 1e-12)
    return out


def centred_ranks(panel: DataFrame, keys: list[str], min_n: int) -> DataFrame:
    """Average ranks of truth and prediction within ``keys``, less their mean, of groups of ``min_n`` rows or more."""
    p = panel.select("*", F.round("y_true", GRID).alias("t"), F.round("y_pred", GRID).alias("q"))
    p = with_group(p, keys, n=F.count(F.lit(1))).where(F.col("n") >= min_n)
    p = group_avg_rank(p, keys, {"t": "rt", "q": "rq"})
    return p.withColumn("rt", F.col("rt") - (F.col("n") + 1) / 2).withColumn("rq", F.col("rq") - (F.col("n") + 1) / 2)


def within_item_rho(panel: DataFrame, *extra: str, min_n: int = 3, name: str = "rho") -> DataFrame:
    """One Pearson correlation of the average ranks of truth and prediction, centred within each item and pooled.

    Items with fewer than ``min_n`` rows don't count; no item left gives null; a pooled side without spread
    gives 0.  ``extra`` columns make groups of their own, one result row each.
    """
    ranked = centred_ranks(panel.select(*extra, "item", "y_true", "y_pred"), [*extra, "item"], min_n)
    rho = F.when(flat("rt", "rq"), 0.0).otherwise(pearson("rt", "rq"))
    return ranked.groupBy(*extra).agg(F.round(rho, 6).alias(name), F.count(F.lit(1)).alias("n"))


def unit_centred(panel: DataFrame, *extra: str) -> DataFrame:
    """Truth and prediction less the unit's means; ``spread`` is whether the prediction keeps any, beside its own size.

    A prediction that is constant within units leaves only rounding dust, which must not be ranked: where its spread is
    at most 1e-9 of that before, every row gives 0.
    """
    p = with_group(checkpointed(panel.select(*extra, "unit", "item", "y_true", "y_pred")), [*extra, "unit"], mt=F.avg("y_true"), mq=F.avg("y_pred"))
    p = p.select(*extra, "unit", "item", (F.col("y_true") - F.col("mt")).alias("y_true"), (F.col("y_pred") - F.col("mq")).alias("y_pred"), F.col("y_pred").alias("_q"))
    whole = p.groupBy(*extra).agg((F.stddev_pop("y_pred") > 1e-9 * F.stddev_pop("_q")).alias("spread"))
    p = p.join(whole, list(extra)) if extra else p.crossJoin(F.broadcast(whole))
    return p.drop("_q").withColumn("y_pred", F.when(F.col("spread"), F.col("y_pred")).otherwise(0.0))


def interaction_rho(panel: DataFrame, *extra: str, min_n: int = 3) -> DataFrame:
    """``within_item_rho`` after each unit's means are taken off.

    On a panel with missing cells the one pass leaves some of the items' own level in; see
    ``interaction_rho_balanced`` for centring both ways.
    """
    return within_item_rho(unit_centred(panel, *extra), *extra, min_n=min_n, name="interaction_rho")


def interaction_rho_balanced(panel: DataFrame, rounds: int = 12, min_n: int = 3) -> DataFrame:
    """The interaction with unit and item means taken off in turn, so that neither level is left on unbalanced panels.

    The levels are fitted on the panel's sums alone: in each round the units' levels are the means of what the items'
    leave, and the other way round, so only a row a unit or item is carried on and the panel is read, not rewritten.
    """
    p = checkpointed(panel.select("unit", "item", "y_true", "y_pred"))
    levels = {"unit": None, "item": p.select("item").distinct().select("item", F.lit(0.0).alias("t"), F.lit(0.0).alias("q"))}
    for i in range(2 * rounds):
        one, other = ("unit", "item") if i % 2 == 0 else ("item", "unit")
        left = p.join(levels[other], other).groupBy(one).agg(F.avg(F.col("y_true") - F.col("t")).alias("t"), F.avg(F.col("y_pred") - F.col("q")).alias("q"))
        levels[one] = checkpointed(left)
    u, v = levels["unit"].toDF("unit", "t", "q"), levels["item"].toDF("item", "t2", "q2")
    p = p.join(u, "unit").join(v, "item").select("item", *[F.round(F.col(y) - F.col(a) - F.col(b), 7).alias(y) for y, a, b in (("y_true", "t", "t2"), ("y_pred", "q", "q2"))])
    return within_item_rho(p, min_n=min_n, name="interaction_rho")


def global_rho(panel: DataFrame) -> DataFrame:
    """Spearman's correlation over all rows."""
    p = panel.select(F.round("y_true", GRID).alias("t"), F.round("y_pred", GRID).alias("q"))
    p = group_avg_rank(p.withColumn("one", F.lit(1)), ["one"], {"t": "rt", "q": "rq"})
    return p.agg(F.round(pearson("rt", "rq"), 6).alias("global_rho"), F.count(F.lit(1)).alias("n"))


def regret_by_unit(panel: DataFrame, k: int, *extra: str) -> DataFrame:
    """Per unit: how far the best truth among the k lowest predictions is from the unit's best, as a share of its range."""
    keys = [*extra, "unit"]
    rn = F.row_number().over(W.partitionBy(*keys).orderBy("y_pred", "item"))
    g = panel.withColumn("rn", rn).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("y_true").alias("lo"), F.max("y_true").alias("hi"), F.min(F.when(F.col("rn") <= k, F.col("y_true"))).alias("got")
    )
    return g.where((F.col("n") >= 2) & (F.col("hi") > F.col("lo"))).select(*keys, ((F.col("got") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("regret"))


def regret_at_k(panel: DataFrame, *ks: int) -> DataFrame:
    """(k, regret, units): the mean normalised regret; units with fewer than two items or no range don't count.

    One pass for all ``ks``: only the most of them of a unit's rows go on to be ranked.
    """
    stats = panel.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("y_true").alias("lo"), F.max("y_true").alias("hi")).where("n >= 2 AND hi > lo")
    rn = F.row_number().over(W.partitionBy("unit").orderBy("y_pred", "item"))
    top = panel.select("unit", "y_true", rn.alias("rn")).where(F.col("rn") <= max(ks)).groupBy("unit").agg(*[F.min(F.when(F.col("rn") <= k, F.col("y_true"))).alias(f"got_{k}") for k in ks])
    each = stats.join(top, "unit").select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col(f"got_{k}") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("regret")) for k in ks])).alias("x"))
    got = each.groupBy("x.k").agg(F.round(F.avg("x.regret"), 6).alias("regret"), F.count(F.lit(1)).alias("units"))
    asked = panel.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    return asked.join(got, "k", "left").fillna(0, ["units"])


def rho_by_item(panel: DataFrame, *extra: str, min_n: int = 3) -> DataFrame:
    """(item, rho): Spearman's correlation within each item; null where a side has no spread."""
    ranked = centred_ranks(panel, [*extra, "item"], min_n)
    return ranked.groupBy(*extra, "item").agg(F.when(~flat("rt", "rq"), pearson("rt", "rq")).alias("rho"))


def per_item_spearman(panel: DataFrame, min_n: int = 3) -> DataFrame:
    """The median over items of their Spearman correlations, items without one left out."""
    r = rho_by_item(panel, min_n=min_n).where("rho IS NOT NULL")
    return r.agg(F.round(F.percentile("rho", F.lit(0.5)), 6).alias("median_rho"), F.count(F.lit(1)).alias("items"))


def within_item_percentile(panel: DataFrame) -> DataFrame:
    p = group_avg_rank(with_group(panel.select("unit", "item", "y_true"), ["item"], n=F.count("y_true")), ["item"], {"y_true": "r"})
    return p.select("unit", "item", F.round(F.col("r") / F.col("n"), 6).alias("pct"))


def top_k_hit_rate(panel: DataFrame, k: int, key: str) -> DataFrame:
    """The share of positives among the k highest predictions; null without positives."""
    top = panel.orderBy(F.desc("y_pred"), key).limit(k)  # the feature is the top k
    hits = top.agg(F.sum(F.when(F.col("y_true") == 1, 1).otherwise(0)).alias("hits"))
    total = panel.agg(F.sum(F.when(F.col("y_true") == 1, 1).otherwise(0)).alias("positives"))
    return hits.crossJoin(total).select("hits", "positives", F.when(F.col("positives") > 0, F.round(F.col("hits") / F.col("positives"), 6)).alias("hit_rate"))


def brier(panel: DataFrame) -> DataFrame:
    return panel.agg(F.round(F.avg((F.col("y_pred") - F.col("y_true")) * (F.col("y_pred") - F.col("y_true"))), 6).alias("brier"), F.count(F.lit(1)).alias("n"))


def calibration_bins(panel: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy): equal bins of [0, 1], an edge belongs to the bin below it."""
    at = F.lit(0)
    for i in range(1, bins):
        at = at + (F.col("y_pred") > F.lit(i / bins)).cast("int")
    return panel.withColumn("bin", at).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("confidence"), F.avg("y_true").alias("accuracy"))


def expected_calibration_error(panel: DataFrame, bins: int = 10) -> DataFrame:
    b = calibration_bins(panel, bins)
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def regret_recall(panel: DataFrame, k: int, *taus: float) -> DataFrame:
    """Per unit with more than k items: raw and normalised regret (no range counts as 1), and for the i-th tau whether an item at or below it was there and was got."""
    rn = F.row_number().over(W.partitionBy("unit").orderBy("y_pred", "item"))
    got = F.col("rn") <= k
    flags = [x for i, t in enumerate(taus) for x in (F.max((F.col("y_true") <= t).cast("int")).alias(f"eligible_{i}"), F.max((got & (F.col("y_true") <= t)).cast("int")).alias(f"hit_{i}"))]
    g = panel.withColumn("rn", rn).groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.min("y_true").alias("lo"), F.max("y_true").alias("hi"), F.min(F.when(got, F.col("y_true"))).alias("best"), *flags
    )
    g = g.where((F.col("n") > k) | F.lit(k == 1))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    raw = F.col("best") - F.col("lo")
    return g.select("unit", F.round(raw, 6).alias("regret"), F.round(raw / span, 6).alias("regret_norm"), *[c for c in g.columns if c.startswith(("eligible_", "hit_"))])


def personalization(panel: DataFrame, min_shared: int = 4) -> DataFrame:
    """(pairs, mean_rho): the mean Spearman correlation of two units' predictions over the items they share; constant sides count as 1.

    Every pair of units is asked for.  Only the order of a unit's items counts, so units of one order are one kind: kinds
    meet item by item, and a pair of kinds stands for all pairs of their units.  Few items make few kinds, however many
    units there are; where each unit has an order of its own, kinds are as many as units.
    """
    p = panel.where("unit IS NOT NULL AND item IS NOT NULL").select("unit", "item", F.round("y_pred", GRID).alias("q"))
    # the place of an item among the unit's, ties alike and null last
    placed = p.select("unit", "item", F.dense_rank().over(W.partitionBy("unit").orderBy(F.asc_nulls_last("q"))).alias("x"))
    kinds = placed.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("item", "x"))).alias("order")).groupBy("order").agg(F.count(F.lit(1)).alias("units"))
    kinds = checkpointed(kinds.select(F.monotonically_increasing_id().alias("u"), "order", "units"))  # numbered once
    each = kinds.select("u", "units", F.explode("order").alias("o")).select("u", "units", "o.item", "o.x")
    a, b = each.toDF("u", "m", "item", "x"), each.toDF("v", "n", "item", "y")
    pair = a.join(b, "item").where("u < v OR (u = v AND m > 1)").withColumn("w", F.when(F.col("u") == F.col("v"), F.col("m") * (F.col("m") - 1) / 2).otherwise(F.col("m") * F.col("n")))
    w = W.partitionBy("u", "v")  # a pair has as many rows as they share items

    def tied_rank(c: str) -> Column:
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("u", "v", c)) - 1) / F.lit(2.0)

    ranked = pair.withColumn("shared", F.count(F.lit(1)).over(w)).where(F.col("shared") >= min_shared).withColumn("rx", tied_rank("x")).withColumn("ry", tied_rank("y"))
    rho = ranked.groupBy("u", "v").agg(F.first("w").alias("w"), F.when(flat("rx", "ry"), 1.0).otherwise(pearson("rx", "ry")).alias("rho"))
    total = F.coalesce(F.sum("w"), F.lit(0)).cast("long")
    return rho.agg(total.alias("pairs"), F.round(F.sum(F.col("w") * F.col("rho")) / F.nullif(F.sum("w"), F.lit(0.0)), 6).alias("mean_rho"))


def window_fit(panel: DataFrame, margin: float = 0.05) -> DataFrame:
    """Pearson overall and inside the observed range of the truth widened by ``margin``, rows outside, and the line through those inside."""
    r = panel.agg(F.min("y_true").alias("lo"), F.max("y_true").alias("hi"))
    p = panel.crossJoin(F.broadcast(r)).withColumn("pad", (F.col("hi") - F.col("lo")) * margin)
    inside = F.col("y_pred").between(F.col("lo") - F.col("pad"), F.col("hi") + F.col("pad"))
    t, q = F.when(inside, F.col("y_true")), F.when(inside, F.col("y_pred"))
    slope = F.try_divide(F.covar_pop(q, t), F.var_pop(t))
    return p.agg(
        F.round(pearson("y_true", "y_pred"), 6).alias("r_all"), F.round(pearson(t, q), 6).alias("r_inside"), F.sum((~inside).cast("int")).alias("outside"),
        F.round(slope, 6).alias("slope"), F.round(F.avg(q) - slope * F.avg(t), 6).alias("intercept"),
    )


def split_half(pairs: DataFrame, min_features: int = 5) -> DataFrame:
    """(line, drug, n, r): Pearson of two halves' profiles (a, b) over the features both have; null without spread."""
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    r = both.groupBy("line", "drug").agg(F.count(F.lit(1)).alias("n"), F.when(~flat("a", "b"), pearson("a", "b")).alias("r"))
    return r.where(F.col("n") >= min_features)


def reliability(halves: DataFrame) -> DataFrame:
    """Quartiles and share above 0 of the halves' correlations, and the mean stepped up to the full length."""
    r = halves.where("r IS NOT NULL")
    q = [F.round(F.percentile("r", F.lit(p)), 6).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return r.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("r"), 6).alias("mean_r"), *q, F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("positive"), F.round(2 * F.avg("r") / (1 + F.avg("r")), 6).alias("stepped_up"))


def signed_rank(pairs: DataFrame) -> DataFrame:
    """Wilcoxon's signed ranks of (a, b), zeros left out: n, the sums of ranks of positive and negative differences, and the normal z."""
    d = pairs.select(F.round(F.col("a") - F.col("b"), GRID).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    r = table_avg_rank(d, "m", "r")
    g = r.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("minus"))
    n = F.col("n")
    return g.select("n", "plus", "minus", F.round((F.col("plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 6).alias("z"))


def row_correlations(pairs: DataFrame, *keys: str, x: str = "y_true", y: str = "y_pred") -> DataFrame:
    """(keys, r): the correlation of two aligned rows; 0 where either has no spread."""
    g = pairs.groupBy(*keys).agg(F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return g.select(*keys, F.when((F.col("sx") < 1e-12) | (F.col("sy") < 1e-12), 0.0).otherwise(F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))
