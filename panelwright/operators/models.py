"""Linear models from moments: every fit is a sum over rows of products, so rows never gather in one task.

``moments`` gives, for each group, n, the sums and the matrix of products of [features, target]; partial sums
are made where the rows are and added up by Spark, cell by cell.  Ridge, lasso, elastic net, leave-fold-out
fits and principal components all start from there; a group's matrix is bounded by the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import checkpointed

ALPHAS = tuple(np.logspace(0, 8, 9))  # fixed values: the grid of penalties
MAX_FEATURES = 2_000
MAX_HELD = 4_000_000  # cells of moments that a task holds before it hands them on


def moments(df: DataFrame, keys: Sequence[str], x: str, y: str | None = None) -> DataFrame:
    """(keys, m): the flat upper half of the products of [1, x..., y] for each group; rows with null parts don't count.

    A partition adds up its groups before it hands anything on, MAX_HELD cells at a time.
    """
    keys = list(keys)
    cols = [*keys, x, *([y] if y else [])]
    have = df.select(*cols).where(F.col(x).isNotNull() & (F.col(y).isNotNull() if y else F.lit(True)))

    def part(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            out = [(*k, m[np.triu_indices(len(m))].tolist()) for k, m in held.items()]
            held.clear()
            return pd.DataFrame(out, columns=[*keys, "m"])

        for pdf in batches:
            if not len(pdf):
                continue
            rows = np.array(pdf[x].tolist(), float)
            full = np.column_stack([np.ones(len(pdf)), rows, *([pdf[y].to_numpy(float)] if y else [])])
            if full.shape[1] > MAX_FEATURES + 2:
                raise ValueError(f"more than {MAX_FEATURES} features")
            index = pdf.groupby(keys, dropna=False, sort=False).indices if keys else {(): np.arange(len(pdf))}
            for at in index.values():
                z, k = full[at], tuple(pdf[c].iloc[at[0]] for c in keys)
                held[k] = held[k] + z.T @ z if k in held else z.T @ z
            if len(held) * full.shape[1] ** 2 > MAX_HELD:
                yield flush()
        yield flush()

    kinds = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "m array<double>"])
    cells = have.mapInPandas(part, kinds).select(*keys, F.posexplode("m").alias("i", "v"))
    added = cells.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    return added.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("m"))


def square(m: Sequence[float]) -> np.ndarray:
    """The whole matrix of an upper half."""
    p = int(round((np.sqrt(8 * len(m) + 1) - 1) / 2))
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = m
    return full + np.triu(full, 1).T


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means, and the centred products of moments."""
    n = max(m[0, 0], 1e-12)
    mean = m[0, 1:] / n
    return m[0, 0], mean, m[1:, 1:] - n * np.outer(mean, mean)


def ridge(m: np.ndarray, alpha: float) -> np.ndarray:
    """[intercept, slopes] with the squared slopes times ``alpha`` as penalty."""
    _, mean, c = centred(m)
    w = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(len(c) - 1), c[:-1, -1])
    return np.concatenate([[mean[-1] - mean[:-1] @ w], w])


def elastic_net(m: np.ndarray, alpha: float, l1: float, rounds: int = 200) -> np.ndarray:
    """[intercept, slopes] of 1/2n RSS + alpha (l1 |w| + (1 - l1)/2 w2), by coordinate descent on the products."""
    n, mean, c = centred(m)
    g, b = c[:-1, :-1] / max(n, 1), c[:-1, -1] / max(n, 1)
    w = np.zeros(len(b))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            r = b[j] - g[j] @ w + g[j, j] * w[j]
            down = g[j, j] + alpha * (1 - l1)
            w[j] = np.sign(r) * max(abs(r) - alpha * l1, 0) / down if down > 0 else 0
        if np.abs(w - before).max(initial=0) < 1e-10:
            break
    return np.concatenate([[mean[-1] - mean[:-1] @ w], w])


def rss(m: np.ndarray, w: np.ndarray) -> float:
    """The squared error of coefficients on the rows behind the moments."""
    v = np.concatenate([w, [-1.0]])
    return float(v @ m @ v)


FITS = {"ridge": lambda m, a: ridge(m, a), "lasso": lambda m, a: elastic_net(m, a, 1.0), "elastic_net": lambda m, a: elastic_net(m, a, 0.5)}


def chosen(parts: Sequence[np.ndarray], kind: str, alphas: Sequence[float]) -> tuple[float, float]:
    """(penalty, squared error) of the least error on parts left out in turn; of equal errors the larger penalty wins."""
    total = sum(parts)
    tried = [(sum(rss(p, FITS[kind](total - p, a)) for p in parts if total[0, 0] > p[0, 0]), -float(a)) for a in alphas]
    error, alpha = min(tried)
    return -alpha, float(error)


def grid(m: np.ndarray, kind: str) -> np.ndarray:
    """The penalties to choose from: 12 for ridge, else 30 from the one that leaves no slope down to its thousandth."""
    if kind == "ridge":
        return np.logspace(-2, 3, 12)
    n, _, c = centred(m)
    top = np.abs(c[:-1, -1]).max(initial=0) / max(n, 1) / {"lasso": 1.0, "elastic_net": 0.5}[kind]
    return max(top, 1e-12) * np.logspace(0, -3, 30)


def fitted(rows: DataFrame, group: Sequence[str], x: str, y: str, fold: str, kind: str = "ridge", alphas: Sequence[float] | None = ALPHAS, min_n: int = 4) -> DataFrame:
    """(group, alpha, error, w): coefficients for each group, the penalty chosen by the squared error on left-out folds.

    Groups of fewer than ``min_n`` rows get none.  Of equal errors the larger penalty wins.  ``alphas`` of None takes the
    grid of the kind, on features of unit spread.
    """
    group = list(group)
    per_fold = moments(rows, [*group, fold], x, y)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [square(m) for m in pdf["m"]]
        total = sum(parts)
        if total[0, 0] < min_n:
            return pd.DataFrame(columns=[*group, "alpha", "error", "w"])
        sd, by = scaled(total) if alphas is None else (1.0, 1.0)
        best, error = chosen([p * by for p in parts], kind, grid(total * by, kind) if alphas is None else alphas)
        w = FITS[kind](total * by, best)
        w[1:] /= sd
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in group], best, error, w.tolist())], columns=[*group, "alpha", "error", "w"])

    kinds = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in group), "alpha double, error double", "w array<double>"])
    # a group has one row a fold
    return (per_fold.groupBy(*group) if group else per_fold.groupBy(F.lit(0).alias("_"))).applyInPandas(fit, kinds)


def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(standard deviations, by), the latter what moments are multiplied by for features of unit spread."""
    n, mean, c = centred(m)
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0) / max(n, 1))
    sd = np.where(sd <= 1e-9 * np.maximum(np.abs(mean[:-1]), 1e-12), 1.0, sd)
    by = np.concatenate([[1.0], 1 / sd, [1.0]])
    return sd, np.outer(by, by)


def out_of_fold(rows: DataFrame, group: Sequence[str], x: str, y: str, fold: str, kind: str, least: int = 8, train: int = 5) -> DataFrame:
    """(group, fold, alpha, w, y_prior): coefficients for each fold from all other folds, and the other folds' mean target.

    Features are scaled, and the penalty is chosen from its grid, by the other folds alone, each left out in turn.
    Groups of fewer than ``least`` rows and folds with fewer than ``train`` others get none.
    """
    group = list(group)
    per_fold = moments(rows, [*group, fold], x, y)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [square(m) for m in pdf["m"]]
        total = sum(parts)
        out = []
        for i, p in enumerate(parts):
            rest = total - p
            if total[0, 0] >= least and rest[0, 0] >= train:
                sd, by = scaled(rest)
                alpha, _ = chosen([q * by for j, q in enumerate(parts) if j != i], kind, grid(rest * by, kind))
                w = FITS[kind](rest * by, alpha)
                w[1:] /= sd
                out.append((*[pdf[k].iloc[i] for k in group], pdf[fold].iloc[i], alpha, w.tolist(), float(rest[0, -1] / rest[0, 0])))
        return pd.DataFrame(out, columns=[*group, fold, "alpha", "w", "y_prior"])

    kinds = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*group, fold]), "alpha double", "w array<double>", "y_prior double"])
    return (per_fold.groupBy(*group) if group else per_fold.groupBy(F.lit(0).alias("_"))).applyInPandas(fit, kinds)


def predicted(x: str = "x", w: str = "w"):
    """The linear prediction of coefficients [intercept, slopes]."""
    slopes = F.zip_with(F.col(x), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a.cast("double") * b)
    return F.col(w)[0] + F.aggregate(slopes, F.lit(0.0), lambda s, v: s + v)


def leading(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, values) of the ``k`` first components of a matrix of products; the largest loading is positive."""
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)[: max(1, min(k, len(values)))]
    v = vectors[:, order]
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1), values[order]


def components(df: DataFrame, x: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, directions, variances) of the ``k`` first principal components, from the summed products."""
    n, mean, c = centred(square(moments(df, [], x).first()["m"]))
    v, values = leading(c / max(n - 1, 1), k)
    return mean, v, values


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda t, v: t + v)


def on_components(df: DataFrame, x: str, mean: np.ndarray, directions: np.ndarray, name: str = "x") -> DataFrame:
    """``df`` with ``name`` the scores of ``x`` along directions that another table may have given, broadcast as one row."""
    shift = [float(a) for a in mean @ directions]
    row = df.sparkSession.createDataFrame([([[float(a) for a in col] for col in directions.T], shift)], "_w array<array<double>>, _o array<double>")
    return df.crossJoin(F.broadcast(row)).withColumn(name, F.zip_with("_w", "_o", lambda w, o: dot(F.col(x), w) - o)).drop("_w", "_o")


def fold_components(profiles: DataFrame, folds: DataFrame, x: str, k: int, unit_spread: bool = False) -> DataFrame:
    """(f, unit, x): for each fold f, every unit's scores on the ``k`` first components of the units outside f.

    Means, spreads and directions come from the moments of the other folds alone, so a fold's units have no part in
    what describes them.  ``profiles``: unit and ``x``; ``folds``: unit, fold.  A feature without spread counts as 0.
    With ``unit_spread`` the scores have spread 1 over the other folds.
    """
    held = profiles.join(folds.select("unit", "fold"), "unit")
    parts = {r["fold"]: square(r["m"]) for r in moments(held, ["fold"], x).collect()}  # a row a fold
    out = []
    for f in sorted(parts):
        rest = sum(parts.values()) - parts[f]
        n, mean, c = centred(rest)
        if n < 1:
            continue
        sd = np.sqrt(np.maximum(np.diag(c), 0) / n)
        by = np.where(sd <= 1e-9 * np.maximum(np.abs(mean), 1e-12), 0.0, 1 / np.where(sd > 0, sd, 1.0))
        v, values = leading(c * np.outer(by, by) / n, k)
        w = by[:, None] * v / (np.sqrt(np.maximum(values, 1e-12)) if unit_spread else 1)
        out.append((f, w.T.tolist(), (mean @ w).tolist()))
    spaces = profiles.sparkSession.createDataFrame(out, f"f {folds.schema['fold'].dataType.simpleString()}, _w array<array<double>>, _o array<double>")
    return profiles.crossJoin(F.broadcast(spaces)).select("f", "unit", F.zip_with("_w", "_o", lambda w, o: dot(F.col(x), w) - o).alias("x"))


def cross_validated(panel: DataFrame, folds: DataFrame, spaces: DataFrame, items: Sequence[str] = ("item",), per_item: bool = True, y: str = "y_true", alphas: Sequence[float] | None = ALPHAS, kind: str = "ridge", min_n: int = 4, least: int = 0, reshape=None) -> DataFrame:
    """(unit, items, fold, y_true, y_pred, y_resid, y_prior, alpha) of every row, predicted by the other folds alone.

    The prior is the other folds' mean of the item, or of all items where it has none; the residual is a linear fit on
    ``spaces`` (f, unit, x), one for each item or one for all, with the penalty chosen inside the other folds, each of
    them left out in turn; an item without a fit has residual 0.  ``reshape`` may turn x into further features before
    the fit, or give each row several times with variants of them, numbered k, of which the best is chosen likewise.  ``alphas`` of None takes the grid of the kind, on features scaled by the other folds.  Items of fewer than
    ``least`` rows are left out; a fit takes ``min_n``.  Folds are a grouping column, so all are fitted at once.
    """
    items = list(items)
    p = panel.select("unit", *items, F.col(y).alias("y_true")).where("y_true IS NOT NULL").join(folds.select("unit", F.col("fold").alias("g")), "unit")
    if least:
        p = p.join(p.groupBy(*items).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least), items, "left_semi")
    p = checkpointed(p)
    by = p.groupBy(*items, F.col("g").alias("f")).agg(F.sum("y_true").alias("s"), F.count(F.lit(1)).alias("k"))
    every = p.select(F.col("g").alias("f")).distinct()  # a row a fold
    whole = by.groupBy(*items).agg(F.sum("s").alias("ts"), F.sum("k").alias("tk")).crossJoin(F.broadcast(every)).join(by, [*items, "f"], "left").fillna(0, ["s", "k"])
    rest = by.groupBy("f").agg(F.sum("s").alias("fs"), F.sum("k").alias("fk")).crossJoin(F.broadcast(by.agg(F.sum("s").alias("as"), F.sum("k").alias("ak"))))
    prior = F.when(F.col("tk") > F.col("k"), (F.col("ts") - F.col("s")) / (F.col("tk") - F.col("k"))).otherwise((F.col("as") - F.col("fs")) / (F.col("ak") - F.col("fk")))
    prior = whole.join(F.broadcast(rest), "f").select(*items, "f", prior.alias("y_prior"))
    rows = p.join(spaces, "unit").join(prior, [*items, "f"]).withColumn("_e", F.col("y_true") - F.col("y_prior"))
    rows = checkpointed(reshape(rows) if reshape else rows)
    group = ["f", *(items if per_item else [])]
    variants = ["k"] if "k" in rows.columns else []
    w = fitted(rows.where("g <> f"), [*group, *variants], "x", "_e", "g", kind, alphas, min_n)
    if variants:
        w = w.groupBy(*group).agg(F.min_by(F.struct("k", "alpha", "w"), F.struct("error", "k")).alias("best")).select(*group, F.col("best.k").alias("_k"), "best.alpha", "best.w")
    out = rows.where("g = f").join(w.select(*group, "alpha", "w", *(["_k"] if variants else [])), group, "left")
    if variants:
        out = out.where(F.col("k") == F.coalesce("_k", F.lit(0)))
    out = out.withColumn("y_resid", F.coalesce(predicted(), F.lit(0.0)))
    return out.select("unit", *items, F.col("f").alias("fold"), "y_true", (F.col("y_prior") + F.col("y_resid")).alias("y_pred"), "y_resid", "y_prior", "alpha")


def reduced(df: DataFrame, x: str, k: int, name: str = "x") -> DataFrame:
    """``df`` with ``name`` the scores on the first ``k`` principal components."""
    mean, v, _ = components(df, x, k)
    return on_components(df, x, mean, v, name)


def standardised(df: DataFrame, x: str) -> DataFrame:
    """``df`` with each coordinate of ``x`` less its mean, by its standard deviation where there is one."""
    n, mean, c = centred(square(moments(df, [], x).first()["m"]))
    sd = np.sqrt(np.maximum(np.diag(c), 0) / max(n, 1))
    sd[sd <= 1e-12 * np.maximum(np.abs(mean), 1)] = 1
    off, by = (F.array(*[F.lit(float(a)) for a in v]) for v in (mean, sd))
    return df.withColumn(x, F.zip_with(F.zip_with(F.col(x), off, lambda a, b: a.cast("double") - b), by, lambda a, b: a / b))


def boosted(df: DataFrame, x: str, y: str, w: Sequence[float], most: int = 300, rounds: int = 400):
    """(model, rows): trees boosted on up to ``most`` coordinates of non-zero slope in ``w``; on the first of all if there is none."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    keep = sorted((i for i in range(len(w)) if w[i] != 0), key=lambda i: (-abs(w[i]), i)) or list(range(len(w)))
    v = checkpointed(df.withColumn("features", array_to_vector(F.array(*[F.col(x)[i] for i in keep[:most]]))))
    return GBTRegressor(labelCol=y, maxIter=rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=1).fit(v), v


def fourier(x: str, dim: int, out: int, gamma: float, seed: int):
    """Random Fourier features whose inner products approach exp(-gamma |a - b|2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(out, dim))
    b = rng.uniform(0, 2 * np.pi, size=out)

    def one(row, shift):
        inner = F.aggregate(F.zip_with(F.col(x), F.array(*[F.lit(float(a)) for a in row]), lambda a, c: a.cast("double") * c), F.lit(float(shift)), lambda s, t: s + t)
        return F.cos(inner) * float(np.sqrt(2 / out))

    return F.array(*[one(r, s) for r, s in zip(w, b, strict=True)])
