"""Readouts of long matrices through named sets of features with a direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import models as L
from panelwright.operators.contracts import Registry
from panelwright.operators.matrix import along, z_scored
from panelwright.session import vocabulary


def sensitivity(m: DataFrame, sets: DataFrame) -> DataFrame:
    """(sample, signature, score): direction times the mean z of the features present; a set without any is left out.

    ``sets``: signature, feature, direction (1 or -1).
    """
    return z_scored(m).join(sets, "feature").groupBy("sample", "signature").agg(F.avg(F.col("value") * F.col("direction")).alias("score"))


def mean_readout(m: DataFrame, sets: DataFrame) -> DataFrame:
    """(sample, score): the mean over signatures, 0 where a sample has none."""
    each = sensitivity(m, sets).groupBy("sample").agg(F.avg("score").alias("score"))
    return m.select("sample").distinct().join(each, "sample", "left").fillna(0.0, ["score"])


def rule_offsets(rows: DataFrame, m: DataFrame, rules: DataFrame) -> DataFrame:
    """(unit, item, residual): the last rule of each item gives the unit's z of the rule's feature, with its sign; others 0.

    ``rules``: rule, item, feature, sign.  The spread is the sample's (n - 1) of ``m``; none counts as 1.
    """
    stats = m.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    z = m.join(stats, "feature").select(F.col("sample").alias("unit"), "feature", ((F.col("value") - F.col("mean")) / F.when(F.coalesce("sd", F.lit(0.0)) < 1e-12, 1.0).otherwise(F.col("sd"))).alias("z"))
    hit = rows.select("unit", "item").join(rules, "item").join(z, ["unit", "feature"])
    last = hit.groupBy("unit", "item").agg(F.max_by(F.col("z") * F.col("sign"), "rule").alias("residual"))
    return rows.select("unit", "item").join(last, ["unit", "item"], "left").fillna(0.0, ["residual"])


READOUTS = Registry("scores")


@READOUTS.register("signatures")
def signature_readout(train: DataFrame, target: DataFrame, sets: DataFrame | None = None, **_: object) -> DataFrame:
    """Nothing is fitted: the mean of the signatures' scores.  ``sets`` must be given."""
    if sets is None:
        raise ValueError("a readout by signatures needs sets")
    return mean_readout(target, sets)


@READOUTS.register("ridge")
def ridge_readout(train: DataFrame, target: DataFrame, alpha: float = 1.0, **_: object) -> DataFrame:
    """(sample, score) of ``target`` (sample, feature, value) by a ridge on ``train``, which has y too; higher is more sensitive, so the label's negative.

    Each side is z-scored by its own samples; features are those of ``train``, and one that ``target`` lacks counts as 0.
    """
    panel = vocabulary(train, "feature", L.MAX_FEATURES)
    y = train.groupBy("sample").agg(F.max("y").alias("y"))
    rows = along(z_scored(train), ["sample"], panel, "x").join(y, "sample").withColumn("fold", F.lit(0))
    w = L.fitted(rows, [], "x", "y", "fold", alphas=(alpha,))  # one row
    known = along(z_scored(target), ["sample"], panel, "x")
    return known.crossJoin(F.broadcast(w)).select("sample", (-L.predicted()).alias("score"))


def readouts(names: list[str] | None, train: DataFrame, target: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(readout, sample, score) of the named readouts, of all that are registered without names; an unknown one is a KeyError."""
    out = None
    for name in READOUTS if names is None else names:  # a handful
        one = READOUTS.run(name, train, target, sets=sets).select(F.lit(name).alias("readout"), "sample", "score")
        out = one if out is None else out.unionByName(one)
    return out
