"""Randomised controls of a panel; all chance comes from hashes of keys, so every engine and run draws the same."""

from __future__ import annotations

import gc
import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.ranks import dealt, with_group
from panelwright.operators.metrics import GRID, interaction_rho
from panelwright.session import checkpointed


AT_ONCE = 20_000_000  # truths dealt before their files are let go
HOT_ITEM = 2_000_000  # rows of an item beyond which its ranks are made by ranges


def uniform(seed: int, *cols: str | Column) -> Column:
    """A number in (0, 1) from the md5 of the seed and the columns."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 48)


def normal(seed: int, *cols: str | Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *cols))) * F.cos(2 * F.pi() * uniform(seed + 1, *cols))


def permuted_within_item(panel: DataFrame, draws: int, seed: int, start: int = 0) -> DataFrame:
    """(b, item, unit, y_true, y_pred): each draw deals an item's truths anew among its units; the values stay the same."""
    p = checkpointed(panel.select("item", "unit", "y_true", "y_pred")).withColumn("b", F.explode(F.sequence(F.lit(start), F.lit(draws - 1))))
    p = dealt(p, ["b", "item"], F.md5(F.concat_ws(":", F.lit(f"{seed} slot"), "b", "item", "unit")), "slot")
    p = checkpointed(dealt(p, ["b", "item"], F.md5(F.concat_ws(":", F.lit(seed), "b", "item", "unit")), "dest"))
    given = p.select("b", "item", F.col("dest").alias("slot"), "y_true")
    return p.select("b", "item", "unit", "slot", "y_pred").join(given, ["b", "item", "slot"]).select("b", "item", "unit", "y_true", "y_pred")


def hash_order(texts: list[bytes], prefix: bytes) -> np.ndarray:
    """The rows in the order of the md5 of their texts after ``prefix``."""
    from hashlib import md5

    h = np.frombuffer(b"".join([md5(prefix + t, usedforsecurity=False).digest() for t in texts]), ">u8").reshape(-1, 2).astype("u8")
    order = np.argsort(h[:, 0], kind="stable")
    first = h[order, 0]
    return np.lexsort((h[:, 1], h[:, 0])) if (first[1:] == first[:-1]).any() else order


def let_go(spark: SparkSession) -> None:
    """Shuffles and checkpoints that nothing refers to any more are removed now, not when the driver happens to collect.

    Python tells the JVM once a second which of its objects are free.
    """
    gc.collect()
    time.sleep(1.2)
    spark._jvm.System.gc()


def dealt_truths(panel: DataFrame, draws: list[int], seed: int, *carried: str) -> DataFrame:
    """(item, unit, t, carried): ``t`` holds the truth that each of ``draws`` deals to the row within its item; draw -1 is the panel as it is."""
    kept = panel.select("item", "unit", *carried)
    columns = kept.columns

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        t, texts = pdf["y_true"].to_numpy(float), [k.encode() for k in pdf["key"]]
        out = np.empty((len(t), len(draws)))
        for j, b in enumerate(draws):
            out[hash_order(texts, f"{seed} slot:{b}:".encode()) if b >= 0 else slice(None), j] = t[hash_order(texts, f"{seed}:{b}:".encode())] if b >= 0 else t
        return pdf[columns].assign(t=list(out))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", t array<double>"
    return panel.select(*columns, "y_true", F.concat_ws(":", "item", "unit").alias("key")).groupBy("item").applyInPandas(deal, shape)


def paired_sums(rows: DataFrame, pairs: list[tuple[int, int, int]], units: int, min_n: int = 3) -> DataFrame:
    """(b, xy, xx, yy, n): summed products of the centred ranks that ``interaction_rho`` correlates, for each of many panels at once.

    ``rows``: item, unit, and arrays t and q of truths and predictions; a panel (b, i, j) has the truth t[i] and the
    prediction q[j], of the rows that have q[j], which is NaN elsewhere.  Panels are columns of one matrix; rows go once
    to their unit, whose means are taken off, and once back to their item.
    """
    kind = rows.schema["item"].dataType.simpleString()
    names, at_t, at_q = [list(c) for c in zip(*pairs, strict=True)]
    used = sorted(set(at_q))
    side = [used.index(j) for j in at_q]

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        code, _ = pd.factorize(pdf["unit"])
        t, q = np.stack(pdf["t"].to_numpy()), np.stack(pdf["q"].to_numpy())[:, used]
        have = ~np.isnan(q)
        n = np.maximum(1, np.column_stack([np.bincount(code, weights=c) for c in have.T]))
        x, y = np.empty((len(t), len(pairs))), np.empty(q.shape)
        for j in range(len(used)):
            y[:, j] = q[:, j] - (np.bincount(code, weights=np.where(have[:, j], q[:, j], 0.0)) / n[:, j])[code]
        for c, (i, j) in enumerate(zip(at_t, side, strict=True)):
            x[:, c] = np.where(have[:, j], t[:, i] - (np.bincount(code, weights=np.where(have[:, j], t[:, i], 0.0)) / n[:, j])[code], np.nan)
        return pd.DataFrame({"item": pdf["item"], "x": list(x), "y": list(y)})

    def ranks(column: pd.Series) -> np.ndarray:
        v = np.stack(column.to_numpy()) * 10.0**GRID
        r = pd.DataFrame(np.trunc(v + np.copysign(0.5, v))).rank().to_numpy()
        return r - ((~np.isnan(r)).sum(0) + 1) / 2

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = ranks(pdf["x"]), ranks(pdf["y"])
        n = (~np.isnan(y)).sum(0)
        n, y = np.where(n < min_n, 0, n), np.where(np.isnan(y) | (n < min_n), 0.0, y)
        x = np.where(np.isnan(x), 0.0, x) * (n[side] > 0)
        xy = [(x[:, c] * y[:, j]).sum() for c, j in enumerate(side)]
        return pd.DataFrame({"b": names, "xy": xy, "xx": (x * x).sum(0), "yy": (y * y).sum(0)[side], "n": n[side]})

    p = rows.groupBy(F.pmod(F.xxhash64("unit"), F.lit(units))).applyInPandas(centre, f"item {kind}, x array<double>, y array<double>")
    p = p.groupBy("item").applyInPandas(rank, "b int, xy double, xx double, yy double, n long")
    return p.groupBy("b").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy", "n")])


def rho_of(sums: Row, spread: bool) -> float:
    """The correlation of a row of ``paired_sums``; 0 where a side is flat."""
    flat = not spread or min(sums["xx"], sums["yy"]) / sums["n"] < 1e-24
    return 0.0 if flat else sums["xy"] / (sums["xx"] * sums["yy"]) ** 0.5


def keeps_spread(q: str) -> Column:
    """Whether predictions less their unit's mean ``_m`` are more than rounding dust."""
    return F.stddev_pop(F.col(q) - F.col("_m")) > 1e-9 * F.stddev_pop(q)


def dealt_sums(panel: DataFrame, start: int, end: int, seed: int, units: int, min_n: int = 3) -> DataFrame:
    """(b, xy, xx, yy, n) of draws ``start`` to ``end``; -1 is the panel as it is."""
    draws = list(range(start, end))
    rows = dealt_truths(panel.withColumn("q", F.array("y_pred")), draws, seed, "q")
    return paired_sums(rows, [(b, i, 0) for i, b in enumerate(draws)], units, min_n).where("n > 0")


def null_rhos(panel: DataFrame, draws: int, seed: int) -> DataFrame:
    """(b, interaction_rho): of each draw, and of the panel itself as b = -1; few draws at a time, whose files are then let go.

    Items of more than HOT_ITEM rows, and panels with nulls or infinite numbers, are ranked by ranges in Spark.
    """
    spark, panel = panel.sparkSession, checkpointed(panel.select("item", "unit", "y_true", "y_pred"))
    odd = F.col("item").isNull() | F.col("unit").isNull() | ~F.coalesce(F.abs(F.col("y_true")) + F.abs(F.col("y_pred")) < float("inf"), F.lit(False))
    sizes = panel.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max(odd).alias("odd")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("odd").alias("odd")).first()
    n, step = sizes["n"] or 0, max(1, AT_ONCE // max(1, sizes["n"] or 0))
    by_ranges = n == 0 or sizes["odd"] or sizes["most"] > HOT_ITEM
    if not by_ranges:
        spread = with_group(panel, ["unit"], _m=F.avg("y_pred")).agg(keeps_spread("y_pred")).first()[0]
    got = []
    for start in range(-1, draws, step):
        end = min(draws, start + step)
        if by_ranges:
            own = panel.select(F.lit(-1).alias("b"), "item", "unit", "y_true", "y_pred")
            dealt_anew = permuted_within_item(panel, end, seed, max(start, 0)) if end > 0 else own.limit(0)
            got += [tuple(r) for r in interaction_rho(own.unionByName(dealt_anew) if start < 0 else dealt_anew, "b").select("b", "interaction_rho").collect()]
        else:
            for r in dealt_sums(panel, start, end, seed, units=max(1, n * (end - start) // 2_000_000)).collect():  # a row a draw
                got.append((r["b"], rho_of(r, spread)))
        if end < draws:
            let_go(spark)
    return spark.createDataFrame(got, "b int, rho double").select("b", F.round("rho", 6).alias("interaction_rho"))


def permutation_p(panel: DataFrame, draws: int, seed: int) -> DataFrame:
    """(interaction_rho, p, draws): the interaction, and the share of permuted panels that reach it."""
    r = null_rhos(panel, draws, seed)
    obs = r.where("b = -1").select(F.col("interaction_rho").alias("obs"))
    return r.where("b >= 0").crossJoin(F.broadcast(obs)).agg(F.first("obs").alias("interaction_rho"), F.round(F.avg((F.col("interaction_rho") >= F.col("obs")).cast("double")), 6).alias("p"), F.count(F.lit(1)).alias("draws"))


def random_sets(features: DataFrame, draws: int, size: int) -> DataFrame:
    """(draw, feature): ``size`` features for each draw."""
    f = features.distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    k = F.row_number().over(W.partitionBy("draw").orderBy(F.md5(F.concat_ws(":", "draw", "feature"))))
    return f.withColumn("k", k).where(F.col("k") <= size).select("draw", "feature")


def shuffled_hit_rate(panel: DataFrame, draws: int, seed: int) -> DataFrame:
    """(b, hit_rate): how often the lowest prediction is the unit's best item, truths dealt anew."""
    p = permuted_within_item(panel, draws, seed).groupBy("b", "unit").agg(F.min_by("item", F.struct("y_true", "item")).alias("best"), F.min_by("item", F.struct("y_pred", "item")).alias("got"))
    return p.groupBy("b").agg(F.round(F.avg((F.col("best") == F.col("got")).cast("double")), 6).alias("hit_rate"))


def planted(panel: DataFrame, effect: float, noise: float, seed: int) -> DataFrame:
    """The panel with a truth made of the item's mean, an effect that each unit and item share, and noise; the prediction knows the effect.

    A unit's direction and an item's are hashed normals, the items' centred over all items, so that the planted
    part is an interaction and no level of the item.
    """
    items = panel.groupBy("item").agg(F.avg("y_true").alias("base")).withColumn("g", normal(seed, F.col("item").cast("string")))
    centre = items.agg(F.avg("g").alias("c"))
    items = items.crossJoin(F.broadcast(centre)).select("item", "base", (F.col("g") - F.col("c")).alias("g"))
    p = panel.join(items, "item").withColumn("z", normal(seed + 10, F.col("unit").cast("string")))
    signal = F.lit(effect) * F.col("z") * F.col("g")
    return p.select("unit", "item", (F.col("base") + signal + noise * normal(seed + 20, F.col("unit").cast("string"), F.col("item").cast("string"))).alias("y_true"), (F.col("base") + signal).alias("y_pred"))


def controls(panel: DataFrame, seed: int) -> DataFrame:
    """(kind, unit, item, y_true, y_pred): the panel as it is, permuted, and with a planted effect."""
    cols = ["unit", "item", "y_true", "y_pred"]
    none = panel.select(F.lit("none").alias("kind"), *cols)
    negative = permuted_within_item(panel, 1, seed).select(F.lit("negative").alias("kind"), *cols)
    positive = planted(panel, 1.0, 0.1, seed).select(F.lit("positive").alias("kind"), *cols)
    return none.unionByName(negative).unionByName(positive)
