"""Queries of selection, splits and controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import controls as C
from panelwright.operators import metrics as M
from panelwright.operators import models as L
from panelwright.operators import scores as Z
from panelwright.operators import selection as S
from panelwright.operators import splits as X
from panelwright.plans import panels as P
from panelwright.plans.registry import query
from panelwright.plans.transfer import side
from panelwright.session import checkpointed, table

ACTIVE = "m AS (SELECT unit, quantile_cont(y_true, 0.5) AS m FROM dense GROUP BY 1), act AS (SELECT item, avg(CAST(y_true < m AS DOUBLE)) AS below FROM dense JOIN m USING (unit) GROUP BY 1 HAVING avg(CAST(y_true < m AS DOUBLE)) > 0.5)"
query("a16_broadly_active", f"WITH {P.DENSE}, {ACTIVE} SELECT item, round(below, 6) AS below FROM act")(lambda s, d: S.broadly_active(P.dense(s, d)).select("item", F.round("below", 6).alias("below")))
query("a17_concentration", f"""WITH {P.DENSE}, {ACTIVE}, c AS (SELECT unit, arg_min(item, (y_pred, item)) AS item FROM dense GROUP BY 1),
e AS (SELECT item, count(*) AS k, max(CASE WHEN item IN (SELECT item FROM act) THEN 1 ELSE 0 END) AS a FROM c GROUP BY 1)
SELECT CAST(sum(k) AS BIGINT) AS units, count(*) AS distinct_items, arg_max(item, (k, item)) AS modal_item, round(max(k) / sum(k), 6) AS modal_share, round(sum(k * a) / sum(k), 6) AS active_share FROM e""")(
    lambda s, d: S.concentration(P.dense(s, d), "y_pred")
)
HIT = "SELECT {k} AS k, round(avg(CAST(coalesce(f, 99) <= {k} AS DOUBLE)), 6) AS hit_rate, count(*) AS units FROM h"
query("a18_class_hit_rate", f"""WITH {P.SPARSE}, t AS (SELECT p_partkey AS item, p_type AS class FROM part), p AS (SELECT s.*, class FROM sparse s LEFT JOIN t USING (item)),
b AS (SELECT unit, arg_min(class, (y_true, item)) AS bc FROM p GROUP BY 1), r AS (SELECT p.*, bc, row_number() OVER (PARTITION BY unit ORDER BY y_pred, item) AS rn FROM p JOIN b USING (unit) WHERE bc IS NOT NULL),
h AS (SELECT unit, min(CASE WHEN class = bc AND rn <= 5 THEN rn END) AS f FROM r GROUP BY 1) {HIT.format(k=1)} UNION ALL {HIT.format(k=3)} UNION ALL {HIT.format(k=5)}""")(
    lambda s, d: S.class_hit_rate(P.sparse(s, d), P.types(s, d), 1, 3, 5)
)
query("a19_interaction_by_class", f"""WITH {P.SPARSE}, p AS (SELECT s.*, p_type AS class FROM sparse s JOIN part ON item = p_partkey),
c AS (SELECT class, unit, item, y_true - avg(y_true) OVER (PARTITION BY class, unit) AS y_true, y_pred - avg(y_pred) OVER (PARTITION BY class, unit) AS y_pred FROM p), {P.ranks_sql("c", "class, item")}
SELECT class, {P.RHO} AS interaction_rho, count(*) AS n FROM r GROUP BY 1""")(lambda s, d: S.interaction_by_class(P.sparse(s, d), P.types(s, d)))  # fmt: skip
query("a25_breadth", f"""WITH {P.DENSE}, c AS (SELECT unit, arg_min(item, (y_true, item)) AS item FROM dense GROUP BY 1), e AS (SELECT b, item, count(*) AS k FROM c, range(20) t(b)
WHERE CAST('0x' || left(md5(b || ':' || unit), 4) AS INTEGER) % 2 = 0 GROUP BY 1, 2), g AS (SELECT b, count(*) AS kinds, max(k) / sum(k) AS modal FROM e GROUP BY 1)
SELECT round(quantile_cont(kinds, 0.025), 6) AS kinds_lo, round(quantile_cont(kinds, 0.5), 6) AS kinds_mid, round(quantile_cont(kinds, 0.975), 6) AS kinds_hi, round(quantile_cont(modal, 0.5), 6) AS modal_mid FROM g""")(
    lambda s, d: S.breadth(P.dense(s, d))
)

# splits
query("x3_leave_unit_out", f"WITH {P.DENSE} SELECT DISTINCT unit, unit AS fold FROM dense")(lambda s, d: X.leave_key_out(P.dense(s, d), "unit"))
query("x2_leave_class_out", "SELECT DISTINCT patient_id AS unit, coalesce(subtype_granularity, '__missing__') AS fold FROM patients")(
    lambda s, d: X.leave_key_out(table(s, d, "patients").select(F.col("patient_id").alias("unit"), "subtype_granularity"), "subtype_granularity", "unit", "__missing__")
)
query("x4_stratified_folds", """WITH p AS (SELECT DISTINCT patient_id AS unit, coalesce(lower(subtype), '__missing__') AS s FROM patients), n AS (SELECT unit, CASE WHEN count(*) OVER (PARTITION BY s) < 5 THEN '__rare__' ELSE s END AS label FROM p),
k AS (SELECT unit, min(label) AS label FROM n GROUP BY 1)
SELECT unit, (row_number() OVER (PARTITION BY label ORDER BY md5('11:' || unit)) - 1) % 5 AS fold FROM k""")(
    lambda s, d: X.stratified_folds(table(s, d, "patients").select(F.col("patient_id").alias("unit"), F.coalesce(F.lower("subtype"), F.lit("__missing__")).alias("label")).distinct(), 5, 11)
)
query("x5_hashed_folds", f"WITH {P.DENSE} SELECT DISTINCT unit, CAST('0x' || left(md5(CAST(unit AS VARCHAR)), 6) AS INTEGER) % 5 AS fold FROM dense")(lambda s, d: X.hashed_folds(P.dense(s, d), 5))
query("x1_balanced_groups", f"""WITH {P.SPARSE}, c AS (SELECT unit, count(*) AS n FROM sparse GROUP BY 1), r AS (SELECT unit, n, row_number() OVER (ORDER BY n DESC, unit) - 1 AS k FROM c)
SELECT unit, n, CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS fold FROM r""")(lambda s, d: X.balanced_group_folds(P.sparse(s, d), 5))  # fmt: skip
query("x6_overlapping_sides", """WITH f AS (SELECT fold_id, unnest(train_patient_ids) AS p, 1 AS side FROM split_folds UNION SELECT fold_id, unnest(test_patient_ids), 2 FROM split_folds)
SELECT fold_id, count(*) AS both FROM (SELECT fold_id, p FROM f WHERE p IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT side) = 2) GROUP BY 1""")(lambda s, d: X.overlapping_sides(table(s, d, "split_folds")))  # fmt: skip

# controls
PERM = """perm AS (SELECT b, item, unit, y_true, y_pred, row_number() OVER (PARTITION BY b, item ORDER BY md5('7 slot:' || b || ':' || item || ':' || unit)) AS slot, row_number() OVER (PARTITION BY b, item ORDER BY md5('7:' || b || ':' || item || ':' || unit)) AS dest FROM dense, range({n}) t(b)),
mixed AS (SELECT a.b, a.item, a.unit, z.y_true, a.y_pred FROM perm a JOIN perm z ON a.b = z.b AND a.item = z.item AND a.slot = z.dest)"""
query("c1_permuted_within_item", f"WITH {P.DENSE}, {PERM.format(n=1)} SELECT item, unit, y_true, y_pred FROM mixed")(
    lambda s, d: C.permuted_within_item(P.dense(s, d), 1, 7).select("item", "unit", "y_true", "y_pred")
)
def null_sql(source, name, n, seed=7):
    """CTEs that deal ``source`` anew within items ``n`` times and give v: the interaction of each draw b, and of the panel itself as b = -1."""
    perm = PERM.replace("dense", source).replace("'7", f"'{seed}").replace("perm", f"perm_{name}").replace("mixed", f"mixed_{name}").format(n=n)
    return f"""{perm}, alls AS (SELECT * FROM mixed_{name} UNION ALL SELECT -1, item, unit, y_true, y_pred FROM {source}),
c AS (SELECT b, unit, item, y_true - avg(y_true) OVER (PARTITION BY b, unit) AS y_true, y_pred - avg(y_pred) OVER (PARTITION BY b, unit) AS y_pred FROM alls), {P.ranks_sql("c", "b, item")},
v AS (SELECT b, {P.RHO} AS rho FROM r GROUP BY 1)"""


OBSERVED = "(SELECT rho FROM v WHERE b = -1)"
query("a12_scores_with_null", f"WITH {P.DENSE}, {null_sql('dense', 'a', 20)} SELECT {OBSERVED} AS interaction_rho, round(avg(CAST(rho >= {OBSERVED} AS DOUBLE)), 6) AS p, count(*) AS draws FROM v WHERE b >= 0")(
    lambda s, d: C.permutation_p(P.dense(s, d), 20, 7)
)
GLOBAL = """gg AS (SELECT round(y_true, 9) AS t, round(y_pred, 9) AS q FROM {0}), gr AS (SELECT rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS rt, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rq FROM gg),
gl AS (SELECT count(*) AS n, round(corr(rt, rq), 6) AS global_rho FROM gr)"""
ITEMS = """{ranks}, i AS (SELECT item, CASE WHEN stddev_pop(rt) >= 1e-12 AND stddev_pop(rq) >= 1e-12 THEN corr(rt, rq) END AS rho FROM ri GROUP BY item)"""


def items_sql(source, least):
    return ITEMS.format(ranks=P.ranks_sql(source, "item", least=least).replace("g AS (SELECT", "gi AS (SELECT", 1).replace("FROM g WHERE", "FROM gi WHERE").replace("\nr AS (", "\nri AS ("))


def regret_sql(source, k):
    return f"""k{k} AS (SELECT round(avg((got - lo) / (hi - lo)), 6) AS regret_{k} FROM (SELECT unit, count(*) AS n, min(y_true) AS lo, max(y_true) AS hi, min(CASE WHEN rn <= {k} THEN y_true END) AS got
  FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY y_pred, item) AS rn FROM {source}) GROUP BY unit) WHERE n >= 2 AND hi > lo)"""


query("a12_score_predictions", f"""WITH {P.DENSE}, {null_sql("dense", "a", 100)}, {GLOBAL.format("dense")}, {items_sql("dense", 3)}, {regret_sql("dense", 1)}, {regret_sql("dense", 3)}
SELECT n, global_rho, {OBSERVED} AS interaction_rho, (SELECT round(avg(CAST(rho >= {OBSERVED} AS DOUBLE)), 6) FROM v WHERE b >= 0) AS p, (SELECT round(quantile_cont(rho, 0.5), 6) FROM i WHERE rho IS NOT NULL) AS median_rho, regret_1, regret_3 FROM gl, k1, k3""")(
    lambda s, d: Z.score_predictions(P.dense(s, d), 100, 7)
)
SCREENS = """sa AS (SELECT l_suppkey AS unit, p_brand AS item, round(avg(l_discount), 9) AS y FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1, 2),
sb AS (SELECT l_suppkey AS unit, p_brand AS item, round(avg(l_discount), 9) AS y FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2), j AS (SELECT unit, item, sa.y AS y_true, sb.y AS y_pred FROM sa JOIN sb USING (unit, item))"""
query("r6_screen_agreement", f"""WITH {SCREENS}, {null_sql("j", "s", 20)}, {GLOBAL.format("j")}, {items_sql("j", 5)}
SELECT n, (SELECT count(DISTINCT unit) FROM j) AS units, (SELECT count(DISTINCT item) FROM j) AS items, global_rho, {OBSERVED} AS interaction_rho, (SELECT round(avg(CAST(rho >= {OBSERVED} AS DOUBLE)), 6) FROM v WHERE b >= 0) AS p,
  (SELECT round(quantile_cont(rho, 0.5), 6) FROM i WHERE rho IS NOT NULL) AS median_rho, (SELECT round(avg(CAST(rho > 0 AS DOUBLE)), 6) FROM i WHERE rho IS NOT NULL) AS positive, (SELECT count(*) FROM i WHERE rho IS NOT NULL) AS scored FROM gl""")(
    lambda s, d: Z.screen_agreement(*[side(s, d, f).withColumnRenamed("y_true", "y") for f in ("A", "R")], 20, 7)
)
CLASSES = "t AS (SELECT DISTINCT p_brand AS item, substr(p_brand, 7, 1) AS class FROM part)"


def brand_classes(s, d):
    return table(s, d, "part").select(F.col("p_brand").alias("item"), F.substring("p_brand", 7, 1).alias("class")).distinct()


query("c5_shuffled_class_hits", f"""WITH {P.DENSE}, {CLASSES}, e AS (SELECT b, unit, item, y_true, y_pred, row_number() OVER (PARTITION BY b ORDER BY md5('7 slot:' || b || ':' || item || ':' || unit)) AS slot, row_number() OVER (PARTITION BY b ORDER BY md5('7:' || b || ':' || item || ':' || unit)) AS dest FROM dense, range(20) q(b)),
x AS (SELECT a.b, a.unit, a.item, a.y_true, z.y_pred, class FROM e a JOIN e z ON a.b = z.b AND a.slot = z.dest JOIN t ON t.item = a.item), bc AS (SELECT b, unit, arg_min(class, (y_true, item)) AS best FROM x GROUP BY 1, 2),
o AS (SELECT b, unit, class, row_number() OVER (PARTITION BY b, unit ORDER BY y_pred, item) AS rn FROM x), h AS (SELECT b, unit, min(CASE WHEN class = best AND rn <= 5 THEN rn END) AS f FROM o JOIN bc USING (b, unit) GROUP BY 1, 2)
SELECT k, round(avg(rate), 6) AS hit_rate FROM (SELECT b, k, round(avg(CAST(coalesce(f, 99) <= k AS DOUBLE)), 6) AS rate FROM h, (VALUES (1), (3), (5)) w(k) GROUP BY 1, 2) GROUP BY 1""")(
    lambda s, d: Z.shuffled_class_hits(P.dense(s, d), brand_classes(s, d), (1, 3, 5), 20, 7)
)
query("c4_random_sets", """WITH f AS (SELECT DISTINCT p_brand AS feature FROM part) SELECT b AS draw, feature FROM (SELECT b, feature, row_number() OVER (PARTITION BY b ORDER BY md5(b || ':' || feature)) AS k FROM f, range(10) t(b)) WHERE k <= 4""")(
    lambda s, d: C.random_sets(table(s, d, "part").select(F.col("p_brand").alias("feature")), 10, 4)
)
query("c5_shuffled_hit_rate", f"""WITH {P.DENSE}, {PERM.format(n=5)}, t AS (SELECT b, unit, arg_min(item, (y_true, item)) AS best, arg_min(item, (y_pred, item)) AS got FROM mixed GROUP BY 1, 2)
SELECT b, round(avg(CAST(best = got AS DOUBLE)), 6) AS hit_rate FROM t GROUP BY 1""")(lambda s, d: C.shuffled_hit_rate(P.dense(s, d), 5, 7))  # fmt: skip

def planted_sql(effect, noise, seed):
    """Round to the grid on which ranks are taken, as logarithms and cosines differ in the last place."""
    return f"""gi0 AS (SELECT item, avg(y_true) AS base, {P.normal_sql(seed, "item")} AS g FROM dense GROUP BY item), gi1 AS (SELECT item, base, g - (SELECT avg(g) FROM gi0) AS g FROM gi0),
pl AS (SELECT unit, item, base + {effect} * {P.normal_sql(seed + 10, "unit")} * g + {noise} * {P.normal_sql(seed + 20, "unit", "item")} AS y_true, base + {effect} * {P.normal_sql(seed + 10, "unit")} * g AS y_pred FROM dense JOIN gi1 USING (item))"""


query("c3_planted_within_item", f"WITH {P.DENSE}, {planted_sql('1.0', '0.5', 3)}, {P.ranks_sql('pl', 'item')} SELECT {P.RHO} AS rho, count(*) AS n FROM r")(
    lambda s, d: M.within_item_rho(C.planted(P.dense(s, d), effect=1.0, noise=0.5, seed=3), name="rho")
)
query("c3_planted_centred", f"WITH {P.DENSE}, {planted_sql('1.0', '0.5', 3)}, c AS (SELECT unit, item, y_true - avg(y_true) OVER (PARTITION BY unit) AS y_true, y_pred - avg(y_pred) OVER (PARTITION BY unit) AS y_pred FROM pl), {P.ranks_sql('c', 'item')} SELECT {P.RHO} AS interaction_rho, count(*) AS n FROM r")(
    lambda s, d: M.interaction_rho(C.planted(P.dense(s, d), effect=1.0, noise=0.5, seed=3))
)


@query("c2_planted_response")
def c2(s, d):
    """How far a cross-validated ridge recovers a response planted along components of the units' profiles, for growing effects."""
    from panelwright.plans.models import profiles

    p, v = P.dense(s, d), profiles(s, d)
    spaces = L.reduced(L.standardised(v, "vector"), "vector", 5).select("unit", "x")
    made = checkpointed(Z.planted_response(p, spaces, (0.0, 0.5, 1.0, 2.0), 1.0, 3))
    folds = checkpointed(X.hashed_folds(p, 5))
    r = L.cross_validated(made, folds, L.fold_components(v, folds, "vector", 5), items=("effect", "item"))
    return M.within_item_rho(r.select("effect", "item", "y_true", F.col("y_resid").alias("y_pred")), "effect", name="recovered")


query("c7_control_kinds", f"""WITH {P.DENSE}, {PERM.format(n=1)}, {planted_sql("1.0", "0.1", 7)}, k AS (SELECT 'none' AS kind, unit, item, y_true, y_pred FROM dense UNION ALL SELECT 'negative', unit, item, y_true, y_pred FROM mixed UNION ALL SELECT 'positive', unit, item, y_true, y_pred FROM pl)
SELECT kind, unit, item, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM k""")(
    lambda s, d: C.controls(P.dense(s, d), 7).select("kind", "unit", "item", *[P.sql_round(c, 6) for c in ("y_true", "y_pred")])
)
