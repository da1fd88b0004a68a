"""Treated-minus-control deltas in long form (line, drug, feature, value), and what they predict for other lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.ranks import leave_one_out_mean
from panelwright.operators import models as L
from panelwright.operators.controls import let_go
from panelwright.operators.matrix import along, reindexed, scaled, z_scored
from panelwright.operators.splits import hashed_folds
from panelwright.session import checkpointed


CELLS = 500_000  # numbers of a block of rows that are compared with all others
AT_ONCE = 20_000_000  # cells whose means are made before their files are let go
TILE = 256  # rows whose comparisons are held at once, with four times as many


def pseudobulk(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, value): the mean over all cells of the group, cells without a stored value counting as zero."""
    n = cells.groupBy(*keys).agg(F.countDistinct("cell").alias("cells"))
    return cells.groupBy(*keys, "feature").agg(F.sum("value").alias("total")).join(n, list(keys)).select(*keys, "feature", (F.col("total") / F.col("cells")).alias("value"))


def real_deltas(cells: DataFrame, to: float = 1e4) -> DataFrame:
    """Log-scaled pseudobulk of every treatment less that of the same line's controls; lines without controls have none.

    ``cells``: cell, line, drug, is_control, feature, value.  A feature missing on one side counts as zero there.
    Many cells are read in parts of the lines, each with all of a line's cells.
    """

    # both sides in one pass: a control's rows have no drug
    side = cells.where("line IS NOT NULL AND is_control IS NOT NULL AND (is_control OR drug IS NOT NULL)").withColumn("drug", F.when(~F.col("is_control"), F.col("drug")))
    keys = ["line", "is_control", "drug"]
    n = checkpointed(side.groupBy(*keys).agg(F.countDistinct("cell").alias("n"))).toDF("_l", "_c", "_d", "n")
    logs, parts = None, -(-(n.agg(F.sum("n")).first()[0] or 1) // AT_ONCE)
    for i in range(parts):  # of all lines
        if parts > 1:
            let_go(cells.sparkSession)
        part = side if parts == 1 else side.where(F.pmod(F.xxhash64("line"), F.lit(parts)) == i)
        total = part.groupBy(*keys, "feature").agg(F.sum("value").alias("total"))
        mean = total.join(n, (F.col("line") == F.col("_l")) & (F.col("is_control") == F.col("_c")) & F.col("drug").eqNullSafe(F.col("_d")))
        one = checkpointed(scaled(mean.select(F.struct(*keys).alias("sample"), "feature", (F.col("total") / F.col("n")).alias("value")), to, log=True).select("sample.*", "feature", "value"))
        logs = one if logs is None else logs.unionByName(one)
        del total, mean
    treated, control = logs.where(~F.col("is_control")).drop("is_control"), logs.where("is_control").select("line", "feature", F.col("value").alias("base"))
    pairs = treated.select("line", "drug").distinct().join(control, "line")
    full = treated.join(control.select("line").distinct(), "line", "left_semi").join(pairs, ["line", "drug", "feature"], "full")
    return full.select("line", "drug", "feature", (F.coalesce("value", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))).alias("value"))


def table_deltas(rows: DataFrame) -> DataFrame:
    """Mean effects of (line, drug, feature, effect) rows."""
    return rows.groupBy("line", "drug", "feature").agg(F.avg("effect").alias("value"))


def additive(deltas: DataFrame) -> DataFrame:
    """(drug, feature, value): the drug's mean delta, which stands for every line."""
    return deltas.groupBy("drug", "feature").agg(F.avg("value").alias("value"))


def additive_left_out(deltas: DataFrame) -> DataFrame:
    """For every treated line, its drug's mean delta over the other lines; a drug that only this line has had gives none."""
    others = leave_one_out_mean(deltas.select("line", "drug", "feature", "value"), ["drug", "feature"], "value", "mean")
    return others.where("mean IS NOT NULL").select("line", "drug", "feature", F.col("mean").alias("value"))


def nearest_treated(deltas: DataFrame, likeness: DataFrame, k: int) -> DataFrame:
    """(query, drug, feature, value): the mean delta of the ``k`` lines most like the query that had the drug.

    ``likeness``: query, line, similarity; of equals the smaller line goes first.
    """
    had = deltas.select("line", "drug").distinct()
    near = likeness.join(had, "line").withColumn("r", F.row_number().over(W.partitionBy("query", "drug").orderBy(F.desc("similarity"), "line"))).where(F.col("r") <= k)
    return near.join(deltas, ["line", "drug"]).groupBy("query", "drug", "feature").agg(F.avg("value").alias("value"))


def generated_deltas(made: DataFrame, base: DataFrame) -> DataFrame:
    """Made profiles (line, drug, feature, value) less the line's baseline, over the features both have; repeated pairs once, the smallest."""
    once = made.groupBy("line", "drug", "feature").agg(F.min("value").alias("value"))
    return once.join(base.withColumnRenamed("value", "base"), ["line", "feature"]).select("line", "drug", "feature", (F.col("value") - F.col("base")).alias("value"))


def measured_pairs(rows: DataFrame, symbols: DataFrame, cap: int) -> DataFrame:
    """(line, drug, feature, value): mean treated less mean control of the line, features under their symbols.

    ``rows``: line, drug, is_control, replicate, feature, value, filtered beforehand to what is to be compared;
    of each line and drug the first ``cap`` replicates count, in the order of their ids.  ``symbols``: feature,
    symbol; features without a symbol are left out, and of several with one symbol the smallest stays.
    """
    reps = rows.select("line", "drug", "replicate").distinct()
    kept = reps.withColumn("r", F.row_number().over(W.partitionBy("line", "drug").orderBy("replicate"))).where(F.col("r") <= cap).drop("r")
    named = symbols.where(F.length("symbol") > 0).groupBy("symbol").agg(F.min("feature").alias("feature"))
    means = rows.join(kept, ["line", "drug", "replicate"], "left_semi").join(named, "feature").groupBy("line", "drug", "is_control", F.col("symbol").alias("feature")).agg(F.avg("value").alias("value"))
    control = means.where("is_control").select("line", "feature", F.col("value").alias("base"))
    return means.where(~F.col("is_control")).join(control, ["line", "feature"]).select("line", "drug", "feature", (F.col("value") - F.col("base")).alias("value"))


def global_deltas(rows: DataFrame) -> DataFrame:
    """(drug, feature, value): the drug's mean over all lines less the mean of all controls."""
    base = rows.where("is_control").groupBy("feature").agg(F.avg("value").alias("base"))
    treated = rows.where(~F.col("is_control")).groupBy("drug", "feature").agg(F.avg("value").alias("value"))
    return treated.join(base, "feature").select("drug", "feature", (F.col("value") - F.col("base")).alias("value"))


def filled_by_drug(values: DataFrame) -> DataFrame:
    """(drug, line, feature, value): every line of a drug along all features of that drug, zero where none is stored."""
    grid = values.select("drug", "line").distinct().join(values.select("drug", "feature").distinct(), "drug")
    return grid.join(values.select("drug", "line", "feature", "value"), ["drug", "line", "feature"], "left").fillna(0.0, ["value"])


def conditional_deltas(rows: DataFrame, base: DataFrame, asked: DataFrame, panel: list[str], k: int, alpha: float = 1.0, min_lines: int = 4) -> DataFrame:
    """(line, drug, feature, value): deltas, in spreads of the control, for the lines of another platform.

    For each drug and feature a ridge leads from the first ``k`` components of a line's control profile to its
    delta; both platforms are z-scored by their own lines, so that their profiles compare.  The slopes alone are
    carried over.  ``base``: line, feature, value of the other platform; ``asked``: line, drug.  A drug measured in
    fewer than ``min_lines`` lines gives nothing.  ``panel`` is a vocabulary of features.
    """
    control = checkpointed(rows.where("is_control").groupBy("line", "feature").agg(F.avg("value").alias("value")))
    spread = control.groupBy("feature").agg(F.stddev_pop("value").alias("sd")).withColumn("sd", F.when(F.col("sd") < 1e-12, 1.0).otherwise(F.col("sd")))
    profile = checkpointed(reindexed(z_scored(control.withColumnRenamed("line", "sample")), panel))
    mean, directions, _ = L.components(profile, "vector", k)
    x = L.on_components(profile, "vector", mean, directions).select(F.col("sample").alias("line"), "x")
    treated = rows.where(~F.col("is_control")).groupBy("line", "drug", "feature").agg(F.avg("value").alias("t"))
    delta = treated.join(control, ["line", "feature"]).join(spread, "feature").select("line", "drug", "feature", ((F.col("t") - F.col("value")) / F.col("sd")).alias("y"))
    folds = hashed_folds(x, 5, "line").withColumnRenamed("unit", "line")
    w = L.fitted(delta.join(x, "line").join(folds, "line"), ["drug", "feature"], "x", "y", "fold", alphas=(alpha,), min_n=min_lines)
    other = L.on_components(reindexed(z_scored(base.withColumnRenamed("line", "sample")), panel), "vector", mean, directions).select(F.col("sample").alias("line"), "x")
    return asked.distinct().join(other, "line").join(w, "drug").select("line", "drug", "feature", (L.predicted() - F.col("w")[0]).alias("value"))


def dense_rows(deltas: DataFrame, panel: list[str]) -> DataFrame:
    """(line, drug, delta): a vector along ``panel`` for every pair, zero where nothing is stored."""
    return along(deltas.select("line", "drug", "feature", "value"), ["line", "drug"], panel, "delta")


def fidelity(made: DataFrame, real: DataFrame, n_top: int, block: int | None = None) -> DataFrame:
    """(line, drug, r, r_off, rank): how like a made delta is its real one, and how far more than the other real ones.

    Features are the ``n_top`` of the greatest population variance among the matched real deltas.  ``r`` is the
    correlation with the own real delta, ``r_off`` the mean with the others, ``rank`` the share of the others
    below ``r``.  Every made row is asked against all real rows, in blocks that are copied for each block of the other
    side: of ``block`` rows, or as many as hold CELLS numbers.  A row without spread correlates 0.
    """
    made, real = checkpointed(made), checkpointed(real)  # each is read several times
    pairs = checkpointed(made.select("line", "drug").distinct().join(real.select("line", "drug").distinct(), ["line", "drug"]))
    shared = made.select("feature").distinct().join(real.select("feature").distinct(), "feature")
    r = real.join(pairs, ["line", "drug"], "left_semi").join(shared, "feature", "left_semi")
    top = r.groupBy("feature").agg(F.var_pop("value").alias("v")).orderBy(F.desc("v"), "feature").limit(n_top)
    panel = sorted(x["feature"] for x in top.collect())  # n_top names
    left = checkpointed(dense_rows(made.join(pairs, ["line", "drug"], "left_semi"), panel))
    right = checkpointed(dense_rows(r, panel))
    n = pairs.count()
    blocks = max(1, math.ceil(n / (block or max(512, CELLS // max(len(panel), 1)))))
    key = F.concat_ws(" ", "line", "drug")
    left = left.select("line", "drug", key.alias("k"), "delta").withColumn("a", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select(key.alias("k"), "delta").withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rows_of(pdf: pd.DataFrame) -> np.ndarray:
        x = np.array(pdf["delta"].tolist()).reshape(len(pdf), -1)
        x = x - x.mean(axis=1, keepdims=True)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size < 1e-12, 1, size)

    own = left.where("b = 0").select("k", "line", "drug", "delta").join(right.where("a = 0").select("k", F.col("delta").alias("other")), "k")

    def diagonal(batches):
        for pdf in batches:
            if len(pdf):
                r_own = (rows_of(pdf[["delta"]]) * rows_of(pdf[["other"]].rename(columns={"other": "delta"}))).sum(1)
                yield pd.DataFrame({"k": pdf["k"], "line": pdf["line"], "drug": pdf["drug"], "r": np.round(r_own, 9)})

    kind = {f.name: f.dataType.simpleString() for f in left.schema}
    mine = own.mapInPandas(diagonal, f"k string, line {kind['line']}, drug {kind['drug']}, r double")
    asked = left.join(mine.select("k", "r"), "k")

    def against(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"k": [], "total": [], "below": [], "others": []})
        # in billionths, as whole numbers, which are compared and added up without dust
        left, right, r_own = rows_of(x) * 1e9, rows_of(y).T.copy(), np.rint(x["r"].to_numpy() * 1e9)[:, None]
        at = pd.Index(y["k"]).get_indexer(x["k"])  # the own real row, which is none of the others
        total, below = np.zeros(len(x)), np.zeros(len(x), int)
        for i in range(0, len(x), TILE):
            rows = slice(i, i + TILE)
            for j in range(0, len(y), 4 * TILE):
                c = left[rows] @ right[:, j : j + 4 * TILE]
                np.rint(c, out=c)
                total[rows] += c.sum(1)
                below[rows] += np.count_nonzero(c < r_own[rows], axis=1)
                mine = np.flatnonzero((at[rows] >= j) & (at[rows] < j + c.shape[1]))
                own = c[mine, at[rows][mine] - j]
                total[i + mine] -= own
                below[i + mine] -= own < r_own[i + mine, 0]
        return pd.DataFrame({"k": x["k"], "total": total / 1e9, "below": below, "others": len(y) - (at >= 0)})

    part = asked.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(against, "k string, total double, below long, others long")
    g = part.groupBy("k").agg(F.sum("total").alias("total"), F.sum("below").alias("below"), F.sum("others").alias("others")).join(mine, "k")
    return g.select("line", "drug", "r", F.when(F.col("others") > 0, F.col("total") / F.col("others")).alias("r_off"), F.when(F.col("others") > 0, F.col("below") / F.col("others")).alias("rank"))
