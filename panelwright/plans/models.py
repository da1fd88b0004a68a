"""Queries of models and cross-validation.  Features of a unit: its profile over brands, reduced."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators import matrix as X
from panelwright.operators import metrics as M
from panelwright.operators import models as L
from panelwright.operators import signatures as V
from panelwright.operators import splits as S
from panelwright.operators.contracts import Registry
from panelwright.plans import panels as P
from panelwright.plans.registry import query
from panelwright.session import checkpointed, table, vocabulary

FOLD = "CAST('0x' || left(md5(CAST(unit AS VARCHAR)), 6) AS INTEGER) % 5"


@query("mod_p1_item_mean_out_of_fold", f"""WITH {P.DENSE}, p AS (SELECT *, {FOLD} AS fold FROM dense), t AS (SELECT item, sum(y_true) AS s, count(*) AS n FROM p GROUP BY 1), f AS (SELECT item, fold, sum(y_true) AS s, count(*) AS n FROM p GROUP BY 1, 2)
SELECT unit, item, p.fold, round((t.s - f.s) / (t.n - f.n), 6) AS y_base FROM p JOIN t USING (item) JOIN f USING (item, fold) WHERE t.n > f.n""")  # fmt: skip
def p1(s, d):
    p = P.dense(s, d)
    return S.fold_out_mean(p, S.hashed_folds(p, 5)).select("unit", "item", "fold", F.round("y_base", 6).alias("y_base"))


query("x8_cross_validated_rho", f"""WITH {P.DENSE}, p AS (SELECT *, {FOLD} AS fold FROM dense), t AS (SELECT item, sum(y_true) AS s, count(*) AS n FROM p GROUP BY 1), f AS (SELECT item, fold, sum(y_true) AS s, count(*) AS n FROM p GROUP BY 1, 2),
q AS (SELECT unit, item, y_true, round((t.s - f.s) / (t.n - f.n), 9) AS y_pred FROM p JOIN t USING (item) JOIN f USING (item, fold) WHERE t.n > f.n), {P.ranks_sql("q", "item")} SELECT {P.RHO} AS rho, count(*) AS n FROM r""")(lambda s, d: cv_rho(s, d))  # fmt: skip


def cv_rho(s, d):
    p = P.dense(s, d)
    q = S.fold_out_mean(p, S.hashed_folds(p, 5)).select("item", "y_true", F.round("y_base", 9).alias("y_pred"))
    return M.within_item_rho(q)


def profiles(s, d):
    """(unit, vector): the unit's scaled profile over brands."""
    e = X.scaled(P.expr(s, d), 1e4, log=True)
    return checkpointed(X.reindexed(e, vocabulary(table(s, d, "part"), "p_brand", L.MAX_FEATURES)).withColumnRenamed("sample", "unit"))


def features(s, d, k=5):
    """(unit, x): the first components of all units' scaled profiles, for fits that are carried elsewhere."""
    return L.reduced(L.standardised(profiles(s, d), "vector"), "vector", k).select("unit", "x")


def held_out(s, d, k=5, unit_spread=False):
    """Cross-validation of the dense panel as a function: every row by the other folds, from which scaler, components, item means and slopes come alone."""
    p = checkpointed(P.dense(s, d))
    folds = checkpointed(S.hashed_folds(p, 5))
    spaces = checkpointed(L.fold_components(profiles(s, d), folds, "vector", k, unit_spread))
    return lambda **how: L.cross_validated(p, folds, spaces, **how)


def shown(r):
    return r.select("unit", "item", "fold", "y_true", F.round("y_pred", 9).alias("y_pred"), F.round("y_resid", 9).alias("y_resid"))


@query("mod_p2_shared_ridge")
def p2(s, d):
    """One slope for all items on the residual of the item's mean, penalty by folds left out inside the training folds."""
    return shown(held_out(s, d)(per_item=False))


query("mod_p3_ridge_by_item")(lambda s, d: shown(held_out(s, d)()))


GAMMAS = tuple(float(g) for g in np.logspace(-2, 0.5, 6))  # fixed values: the widths tried


def kernels(r):
    """``r`` six times, with its Fourier features for each width, numbered k."""
    maps = F.array(*[F.struct(F.lit(k).alias("k"), L.fourier("x", 5, 24, g, 9).alias("x")) for k, g in enumerate(GAMMAS)])
    return r.withColumn("_m", F.explode(maps)).drop("x").select("*", "_m.k", "_m.x").drop("_m")


@query("mod_p4_kernel_by_item")
def p4(s, d):
    """Kernel ridge through random Fourier features, so that it too needs only summed products; width and penalty chosen in the training folds."""
    return shown(held_out(s, d, unit_spread=True)(alphas=tuple(np.logspace(-2, 3, 6)), reshape=kernels))


def item_features(s, d):
    """(item, g): items are described by size and price."""
    part = table(s, d, "part").groupBy(F.col("p_brand").alias("item")).agg(F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"))
    return part.select("item", F.array((F.col("a") - 25) / 5, (F.col("b") - 1500) / 100).alias("g"))


@query("mod_p5_bilinear")
def p5(s, d):
    """Ridge on unit features, item features and their products; an item without features counts as all zero."""
    g = item_features(s, d).withColumnRenamed("g", "_g")

    def products(r):
        held = r.join(g, "item", "left").withColumn("_g", F.coalesce("_g", F.array(F.lit(0.0), F.lit(0.0))))
        return held.withColumn("x", X.bilinear(F.col("x"), F.col("_g"))).drop("_g")

    return shown(held_out(s, d, 3)(per_item=False, reshape=products))


@query("mod_p8_penalised_grid")
def p8(s, d):
    """Per item and fold, ridge, lasso and elastic net of the other folds, the penalty from the kind's grid chosen there; y_prior is the other folds' mean."""
    out, validated = None, held_out(s, d)
    for kind in ("ridge", "lasso", "elastic_net"):
        one = validated(kind=kind, alphas=None, min_n=5, least=8).select(F.lit(kind).alias("penalty"), "unit", "item", "fold", "y_true", F.round("y_pred", 9).alias("y_pred"), F.round("y_prior", 9).alias("y_prior"))
        out = one if out is None else out.unionByName(one)
    return out


def prior(s, d):
    """The prior alone, from two training rows on, as its SQL has it."""
    p = P.dense(s, d)
    r = S.fold_out_mean(p, S.hashed_folds(p, 5))
    n = r.groupBy("item", "fold").agg(F.count(F.lit(1)).alias("k")).join(r.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item").where("n - k >= 2").select("item", "fold")
    return r.join(n, ["item", "fold"], "left_semi").select(F.lit("ridge").alias("penalty"), "unit", "item", F.round("y_base", 6).alias("y_prior"))


query("mod_p8_prior", f"""WITH {P.DENSE}, p AS (SELECT *, {FOLD} AS fold FROM dense), t AS (SELECT item, sum(y_true) AS s, count(*) AS n FROM p GROUP BY 1), f AS (SELECT item, fold, sum(y_true) AS s, count(*) AS n FROM p GROUP BY 1, 2)
SELECT DISTINCT 'ridge' AS penalty, unit, item, round((t.s - f.s) / (t.n - f.n), 6) AS y_prior FROM p JOIN t USING (item) JOIN f USING (item, fold) WHERE t.n - f.n >= 2""")(
    prior
)

HEADS = Registry("parts")
HEADS.register("item_mean")(lambda validated: validated(min_n=1 << 30))  # no item has so many rows, so none has a slope
HEADS.register("shared_ridge")(lambda validated: validated(per_item=False))
HEADS.register("ridge_by_item")(lambda validated: validated())
HEADS.register("lasso_by_item")(lambda validated: validated(kind="lasso", alphas=None, min_n=5, least=8))


@query("mod_p7_heads")
def heads(s, d):
    """Every registered head by name, all out of fold: how its residuals rank the units within items, and the interaction of its predictions."""
    out, validated = None, held_out(s, d)
    for name in HEADS:  # a handful
        r = checkpointed(HEADS.run(name, validated))
        one = M.within_item_rho(r.select("item", "y_true", F.col("y_resid").alias("y_pred"))).crossJoin(F.broadcast(M.interaction_rho(r).select("interaction_rho")))
        one = one.select(F.lit(name).alias("head"), "rho", "interaction_rho", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("v5_readouts")
def v5(s, d):
    """Registered readouts of one half of the suppliers by the other: the mean of the signatures, and a ridge on the mean discount."""
    from panelwright.plans.deltas import sets

    e = P.expr(s, d)
    y = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.avg("l_discount").alias("y"))
    return V.readouts(None, e.where("sample % 2 = 0").join(y, "sample"), e.where("sample % 2 = 1"), sets(s, d)).select("readout", "sample", F.round("score", 6).alias("score"))


# on one feature a ridge has a closed form, so SQL can say the whole cross-validation
ONE = f"""{P.DENSE}, u AS (SELECT l_suppkey AS unit, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1), p AS (SELECT dense.*, {FOLD} AS g FROM dense), un AS (SELECT unit, v, {FOLD} AS g FROM u WHERE unit IN (SELECT unit FROM p)),
s AS (SELECT f, avg(v) FILTER (WHERE g <> f) AS mv, stddev_pop(v) FILTER (WHERE g <> f) AS sv FROM un, (SELECT DISTINCT g AS f FROM un) GROUP BY 1),
i AS (SELECT f, item, avg(y_true) AS y_prior FROM p, (SELECT DISTINCT g AS f FROM p) WHERE g <> f GROUP BY 1, 2), r AS (SELECT s.f, p.*, (v - mv) / sv AS x, y_prior, y_true - y_prior AS e FROM p JOIN u USING (unit), s JOIN i ON i.f = s.f WHERE i.item = p.item),
m AS (SELECT {{group}}, count(*) AS n, avg(x) AS mx, avg(e) AS me, var_pop(x) * count(*) AS xx, covar_pop(x, e) * count(*) AS xe FROM r WHERE g <> f GROUP BY {{group}}),
o AS (SELECT unit, item, g AS fold, y_true, y_prior, coalesce(CASE WHEN n >= 4 THEN me + xe / (xx + 1.0) * (x - mx) END, 0) AS y_resid FROM r LEFT JOIN m USING ({{group}}) WHERE g = f)"""
SHOW = "SELECT unit, item, fold, round(y_true, 6) AS y_true, round(y_prior + y_resid, 6) AS y_pred, round(y_resid, 6) AS y_resid FROM o"


def on_price(s, d, per_item):
    """A ridge of penalty 1 on the unit's mean price, scaled by the other folds."""
    p = P.dense(s, d)
    folds = checkpointed(S.hashed_folds(p, 5))
    price = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.avg("l_extendedprice").alias("v")).select("unit", F.array("v").alias("vector"))
    return L.cross_validated(p, folds, L.fold_components(price, folds, "vector", 1), per_item=per_item, alphas=(1.0,))


def rounded(r):
    return r.select("unit", "item", "fold", *[P.sql_round(c, 6) for c in ("y_true", "y_pred", "y_resid")])


query("mod_p2_shared_ridge_on_price", f"WITH {ONE.format(group='f')} {SHOW}")(lambda s, d: rounded(on_price(s, d, False)))
query("mod_p3_ridge_on_price_by_item", f"WITH {ONE.format(group='f, item')} {SHOW}")(lambda s, d: rounded(on_price(s, d, True)))


@query("x8_cross_validated_ridge")
def cv_ridge(s, d):
    """How well the residuals of the ridge by item, all out of fold, rank the units within items, and the interaction of the whole predictions."""
    r = checkpointed(held_out(s, d)())
    return M.within_item_rho(r.select("item", "y_true", F.col("y_resid").alias("y_pred"))).crossJoin(F.broadcast(M.interaction_rho(r).select("interaction_rho")))


@query("v3_ridge_readout", """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding[1:1]][1] AS x, CAST(label AS DOUBLE) AS y FROM embeddings), m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM e),
w AS (SELECT sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1.0) AS w, any_value(mx) AS mx, any_value(my) AS my FROM e, m) SELECT vec_id, round(my + w * (x - mx), 6) AS y_pred FROM e, w""")  # fmt: skip
def v3(s, d):
    """Ridge with penalty 1 on one coordinate, whose closed form SQL can say; the operator takes any number."""
    e = table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 1), lambda x: x.cast("double")).alias("x"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    w = L.fitted(e, [], "x", "y", "fold", alphas=(1.0,))
    return e.crossJoin(F.broadcast(w)).select("vec_id", F.round(L.predicted(), 6).alias("y_pred"))


def readouts(s, d):
    """(vec_id, x, y, fold): every coordinate, z-scored, and the label."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return L.standardised(e, "x")


@query("v3_ridge_readout_all")
def v3_all(s, d):
    """Ridge with penalty 1 on all coordinates, z-scored."""
    e = readouts(s, d)
    w = L.fitted(e, [], "x", "y", "fold", alphas=(1.0,))
    return e.crossJoin(F.broadcast(w)).select("vec_id", F.round(L.predicted(), 6).alias("y_pred"))


@query("v4_boosted_trees")
def v4(s, d):
    """Up to 300 features chosen by an elastic net, then 400 gradient-boosted trees (the library's)."""
    e = checkpointed(readouts(s, d))
    w = L.fitted(e, [], "x", "y", "fold", kind="elastic_net", alphas=(0.01, 0.05, 0.2)).first()["w"][1:]
    model, v = L.boosted(e, "x", "y", w)
    return model.transform(v).select("vec_id", F.round("prediction", 6).alias("y_pred"))


@query("n12_principal_components")
def n12(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return L.reduced(e, "e", 4).select("vec_id", F.transform("x", lambda v: F.round(v, 6)).alias("scores"))


@query("n13_nonnegative_factors")
def n13(s, d):
    """Non-negative factors of the samples' profiles, by alternating least squares over the stored cells."""
    from pyspark.ml.recommendation import ALS

    e = P.expr(s, d).select(F.col("sample").cast("int").alias("user"), F.pmod(F.xxhash64("feature"), F.lit(1 << 30)).cast("int").alias("item"), "value")
    model = ALS(rank=4, maxIter=5, regParam=0.1, nonnegative=True, userCol="user", itemCol="item", ratingCol="value", seed=3).fit(e)
    return model.userFactors.select(F.col("id").alias("sample"), F.transform("features", lambda v: F.round(v, 4)).alias("factors"))


@query("d5_learned_deltas")
def d5(s, d):
    """Drug mean plus a ridge from the line's components to each feature's residual, one fit a drug and feature, every line by the other folds' lines."""
    from panelwright.operators import deltas as D

    real = D.real_deltas(P.cells(s, d)).withColumnRenamed("line", "unit")
    folds = checkpointed(S.hashed_folds(real, 5))
    out = L.cross_validated(real, folds, L.fold_components(profiles(s, d), folds, "vector", 5), items=("drug", "feature"), y="value")
    return out.select(F.col("unit").alias("line"), "drug", "feature", F.round("y_pred", 6).alias("value"))


@query("x9_refitted_null", f"""WITH {P.DENSE}, perm AS (SELECT b, item, unit, y_true, row_number() OVER (PARTITION BY b, item ORDER BY md5('5 slot:' || b || ':' || item || ':' || unit)) AS slot, row_number() OVER (PARTITION BY b, item ORDER BY md5('5:' || b || ':' || item || ':' || unit)) AS dest FROM dense, range(20) t(b)),
p AS (SELECT a.b, a.item, a.unit, z.y_true, {FOLD.replace("unit", "a.unit")} AS fold FROM perm a JOIN perm z ON a.b = z.b AND a.item = z.item AND a.slot = z.dest),
t AS (SELECT b, item, sum(y_true) AS s, count(*) AS n FROM p GROUP BY 1, 2), f AS (SELECT b, item, fold, sum(y_true) AS s, count(*) AS n FROM p GROUP BY 1, 2, 3),
q AS (SELECT b, unit, item, y_true, round((t.s - f.s) / (t.n - f.n), 9) AS y_pred FROM p JOIN t USING (b, item) JOIN f USING (b, item, fold) WHERE t.n > f.n), {P.ranks_sql("q", "b, item")} SELECT b, {P.RHO} AS rho, count(*) AS n FROM r GROUP BY 1""")  # fmt: skip
def x9(s, d):
    """Truths permuted within items, and the whole cross-validation run on each of twenty draws at once."""
    from panelwright.operators.controls import permuted_within_item

    draws = permuted_within_item(P.dense(s, d), 20, 5)
    q = S.fold_out_mean(draws, S.hashed_folds(P.dense(s, d), 5), extra=("b",))
    return M.within_item_rho(q.select("b", "item", "y_true", F.round("y_base", 9).alias("y_pred")), "b")
