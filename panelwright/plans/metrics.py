"""Queries of the panel metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import metrics as M
from panelwright.plans import panels as P
from panelwright.plans.registry import query
from panelwright.session import table

CENTRED = "c AS (SELECT unit, item, y_true - avg(y_true) OVER (PARTITION BY unit) AS y_true, y_pred - avg(y_pred) OVER (PARTITION BY unit) AS y_pred FROM {})"


@query("a1_group_aggregates", """SELECT l_suppkey AS unit, count(*) AS n, count(DISTINCT l_partkey) AS items, round(avg(l_discount), 10) AS mean_discount, sum(l_quantity) AS total
FROM lineitem GROUP BY 1""")  # fmt: skip
def a1(s, d):
    g = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("items"), F.round(F.avg("l_discount"), 10).alias("mean_discount"), F.sum("l_quantity").alias("total"))


query("a7_within_item_rho", f"WITH {P.DENSE}, {P.ranks_sql('dense', 'item')} SELECT {P.RHO} AS rho, count(*) AS n FROM r")(lambda s, d: M.within_item_rho(P.dense(s, d)))
query("a8_interaction_rho", f"WITH {P.SPARSE}, {CENTRED.format('sparse')}, {P.ranks_sql('c', 'item')} SELECT {P.RHO} AS interaction_rho, count(*) AS n FROM r")(
    lambda s, d: M.interaction_rho(P.sparse(s, d))
)
query("a8_interaction_rho_dense", f"WITH {P.DENSE}, {CENTRED.format('dense')}, {P.ranks_sql('c', 'item')} SELECT {P.RHO} AS interaction_rho, count(*) AS n FROM r")(
    lambda s, d: M.interaction_rho(P.dense(s, d))
)
query("a8b_interaction_rho_balanced")(lambda s, d: M.interaction_rho_balanced(P.dense(s, d)))
query("a9_global_rho", f"""WITH {P.DENSE}, g AS (SELECT round(y_true, 9) AS t, round(y_pred, 9) AS q FROM dense),
r AS (SELECT rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS rt, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rq FROM g)
SELECT round(corr(rt, rq), 6) AS global_rho, count(*) AS n FROM r""")(lambda s, d: M.global_rho(P.dense(s, d)))  # fmt: skip

REGRET = """k{k} AS (SELECT {k} AS k, round(avg((got - lo) / (hi - lo)), 6) AS regret, count(*) AS units FROM (
  SELECT unit, count(*) AS n, min(y_true) AS lo, max(y_true) AS hi, min(CASE WHEN rn <= {k} THEN y_true END) AS got FROM o GROUP BY unit) WHERE n >= 2 AND hi > lo)"""
query("a10_regret_at_k", f"""WITH {P.SPARSE}, o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY y_pred, item) AS rn FROM sparse),
{REGRET.format(k=1)}, {REGRET.format(k=3)} SELECT * FROM k1 UNION ALL SELECT * FROM k3""")(lambda s, d: M.regret_at_k(P.sparse(s, d), 1, 3))  # fmt: skip

BY_ITEM = "i AS (SELECT item, CASE WHEN stddev_pop(rt) >= 1e-12 AND stddev_pop(rq) >= 1e-12 THEN corr(rt, rq) END AS rho FROM r GROUP BY item)"
query("a11_per_item_spearman", f"WITH {P.DENSE}, {P.ranks_sql('dense', 'item')}, {BY_ITEM} SELECT round(quantile_cont(rho, 0.5), 6) AS median_rho, count(*) AS items FROM i WHERE rho IS NOT NULL")(
    lambda s, d: M.per_item_spearman(P.dense(s, d))
)
query("a15_within_item_percentile", f"""WITH {P.DENSE} SELECT unit, item, round((rank() OVER (PARTITION BY item ORDER BY y_true) + (count(*) OVER (PARTITION BY item, y_true) - 1) / 2.0)
/ count(*) OVER (PARTITION BY item), 6) AS pct FROM dense""")(lambda s, d: M.within_item_percentile(P.dense(s, d)))  # fmt: skip
query("a20_top_k_hit_rate", f"""WITH {P.PROBS}, top AS (SELECT * FROM probs ORDER BY y_pred DESC, prediction_id LIMIT 200),
h AS (SELECT CAST(sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM top), p AS (SELECT CAST(sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM probs)
SELECT hits, positives, round(hits / positives, 6) AS hit_rate FROM h, p""")(lambda s, d: M.top_k_hit_rate(P.probs(s, d), 200, "prediction_id"))  # fmt: skip
query("a21_brier", f"WITH {P.PROBS} SELECT round(avg((y_pred - y_true) * (y_pred - y_true)), 6) AS brier, count(*) AS n FROM probs")(lambda s, d: M.brier(P.probs(s, d)))
query("a22_calibration_error", f"""WITH {P.PROBS}, b AS (SELECT {" + ".join(f"CAST(y_pred > {i / 10}::DOUBLE AS INTEGER)" for i in range(1, 10))} AS bin, y_true, y_pred FROM probs),
a AS (SELECT bin, count(*) AS n, avg(y_pred) AS c, avg(y_true) AS t FROM b GROUP BY 1) SELECT round(sum(n * abs(c - t)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM a""")(
    lambda s, d: M.expected_calibration_error(P.probs(s, d))
)
query("a23_regret_recall", f"""WITH {P.DENSE}, o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY y_pred, item) AS rn FROM dense),
g AS (SELECT unit, count(*) AS n, min(y_true) AS lo, max(y_true) AS hi, min(CASE WHEN rn <= 3 THEN y_true END) AS best, max(CAST(y_true <= 0.04 AS INTEGER)) AS eligible_0,
  max(CAST(rn <= 3 AND y_true <= 0.04 AS INTEGER)) AS hit_0 FROM o GROUP BY 1)
SELECT unit, round(best - lo, 6) AS regret, round((best - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END, 6) AS regret_norm, eligible_0, hit_0 FROM g WHERE n > 3""")(
    lambda s, d: M.regret_recall(P.dense(s, d), 3, 0.04)
)


@query("a24_personalization", """WITH p AS (SELECT user_id AS unit, event_type AS item, round(avg(value), 9) AS q FROM events GROUP BY 1, 2),
j AS (SELECT a.unit AS u, b.unit AS v, a.q AS x, b.q AS y FROM p a JOIN p b ON a.item = b.item AND a.unit < b.unit),
n AS (SELECT *, count(*) OVER (PARTITION BY u, v) AS n FROM j),
k AS (SELECT u, v, rank() OVER (PARTITION BY u, v ORDER BY x) + (count(*) OVER (PARTITION BY u, v, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY u, v ORDER BY y) + (count(*) OVER (PARTITION BY u, v, y) - 1) / 2.0 AS ry FROM n WHERE n >= 4),
e AS (SELECT u, v, CASE WHEN stddev_pop(rx) < 1e-12 OR stddev_pop(ry) < 1e-12 THEN 1.0 ELSE corr(rx, ry) END AS rho FROM k GROUP BY 1, 2)
SELECT count(*) AS pairs, round(avg(rho), 6) AS mean_rho FROM e""")  # fmt: skip
def a24(s, d):
    p = table(s, d, "events").groupBy(F.col("user_id").alias("unit"), F.col("event_type").alias("item")).agg(F.round(F.avg("value"), 9).alias("y_pred"))
    return M.personalization(p)


query("a27_window_fit", f"""WITH {P.DENSE}, b AS (SELECT min(y_true) AS lo, max(y_true) AS hi FROM dense),
p AS (SELECT y_true, y_pred, y_pred BETWEEN lo - (hi - lo) * 0.05 AND hi + (hi - lo) * 0.05 AS ok FROM dense, b)
SELECT round(corr(y_true, y_pred), 6) AS r_all, round(corr(y_true, y_pred) FILTER (WHERE ok), 6) AS r_inside, CAST(sum(CAST(NOT ok AS INTEGER)) AS BIGINT) AS outside,
  round(regr_slope(y_pred, y_true) FILTER (WHERE ok), 6) AS slope, round(regr_intercept(y_pred, y_true) FILTER (WHERE ok), 6) AS intercept FROM p""")(lambda s, d: M.window_fit(P.dense(s, d)))  # fmt: skip

HALVES = f"""{P.CELLS}, h AS (SELECT line, drug, feature, avg(value) FILTER (WHERE k = 0) AS a, avg(value) FILTER (WHERE k = 1) AS b
  FROM (SELECT *, CAST(('0x' || right(md5(CAST(plate AS VARCHAR)), 1)) AS INTEGER) % 2 AS k FROM cells) GROUP BY 1, 2, 3),
s AS (SELECT line, drug, count(*) AS n, CASE WHEN stddev_pop(a) >= 1e-12 AND stddev_pop(b) >= 1e-12 THEN corr(a, b) END AS r FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5)"""


def halves(s, d):
    k = F.conv(F.substring(F.md5(F.col("plate").cast("string")), -1, 1), 16, 10).cast("int") % 2
    c = P.cells(s, d).withColumn("k", k)
    return c.groupBy("line", "drug", "feature").agg(F.avg(F.when(F.col("k") == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("k") == 1, F.col("value"))).alias("b"))


query("a4_split_by_hash", f"WITH {HALVES} SELECT line, drug, feature, round(a, 6) AS a, round(b, 6) AS b FROM h")(
    lambda s, d: halves(s, d).select("line", "drug", "feature", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))
)
query("a29_split_half", f"WITH {HALVES} SELECT line, drug, n, round(r, 6) AS r FROM s")(lambda s, d: M.split_half(halves(s, d)).select("line", "drug", "n", F.round("r", 6).alias("r")))
query("a28_reliability", f"""WITH {HALVES} SELECT count(*) AS pairs, round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75), 6) AS q3,
round(avg(CAST(r > 0 AS DOUBLE)), 6) AS positive, round(2 * avg(r) / (1 + avg(r)), 6) AS stepped_up FROM s WHERE r IS NOT NULL""")(lambda s, d: M.reliability(M.split_half(halves(s, d))))  # fmt: skip

query("a30_signed_rank", f"""WITH {P.DENSE}, w AS (SELECT round(y_true - y_pred, 9) AS x FROM dense), k AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0 AS r FROM w WHERE x <> 0),
g AS (SELECT count(*) AS n, sum(CASE WHEN x > 0 THEN r ELSE 0.0 END) AS plus, sum(CASE WHEN x < 0 THEN r ELSE 0.0 END) AS minus FROM k)
SELECT n, plus, minus, round((plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) AS z FROM g""")(
    lambda s, d: M.signed_rank(P.dense(s, d).select(F.col("y_true").alias("a"), F.col("y_pred").alias("b")))
)
