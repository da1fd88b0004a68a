"""Queries of deltas and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import deltas as D
from panelwright.operators import scores as Z6
from panelwright.operators import signatures as V
from panelwright.plans import panels as P
from panelwright.plans.matrix import Z
from panelwright.plans.registry import query
from panelwright.session import checkpointed, table

BULK = "n{0} AS (SELECT {1}, count(DISTINCT cell) AS k FROM cells WHERE {2} GROUP BY {1}), b{0} AS (SELECT {1}, feature, sum(value) / any_value(k) AS value FROM cells JOIN n{0} USING ({1}) WHERE {2} GROUP BY {1}, feature), s{0} AS (SELECT {1}, feature, ln(1 + value / sum(value) OVER (PARTITION BY {1}) * 10000) AS value FROM b{0})"
REAL = f"""{P.CELLS}, {BULK.format("t", "line, drug", "NOT is_control")}, {BULK.format("c", "line", "is_control")},
pairs AS (SELECT p.line, p.drug, feature, value AS base FROM (SELECT DISTINCT line, drug FROM st WHERE line IN (SELECT line FROM sc)) p JOIN sc USING (line)),
real AS (SELECT coalesce(t.line, p.line) AS line, coalesce(t.drug, p.drug) AS drug, coalesce(t.feature, p.feature) AS feature, coalesce(t.value, 0) - coalesce(base, 0) AS value
  FROM (SELECT * FROM st WHERE line IN (SELECT line FROM sc)) t FULL JOIN pairs p ON t.line = p.line AND t.drug = p.drug AND t.feature = p.feature)"""


def real(s, d):
    return D.real_deltas(P.cells(s, d))


def shown(df):
    return df.select(*[c for c in df.columns if c != "value"], F.round("value", 6).alias("value"))


query("a3_pseudobulk", f"WITH {P.CELLS}, {BULK.format('t', 'line, drug', 'NOT is_control')} SELECT line, drug, feature, round(value, 6) AS value FROM bt")(lambda s, d: shown(D.pseudobulk(P.cells(s, d).where(~F.col("is_control")), "line", "drug")))
query("d1_real_deltas", f"WITH {REAL} SELECT line, drug, feature, round(value, 6) AS value FROM real")(lambda s, d: shown(real(s, d)))
query("d2_table_deltas", "SELECT l_suppkey AS line, l_returnflag AS drug, left(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 4) AS feature, round(avg(l_tax - l_discount), 6) AS value FROM lineitem GROUP BY 1, 2, 3")(
    lambda s, d: shown(D.table_deltas(table(s, d, "lineitem").select(F.col("l_suppkey").alias("line"), F.col("l_returnflag").alias("drug"), F.substring(F.col("l_shipdate").cast("date").cast("string"), 1, 4).alias("feature"), (F.col("l_tax") - F.col("l_discount")).alias("effect"))))
)
query("d4_additive", f"WITH {REAL} SELECT drug, feature, round(avg(value), 6) AS value FROM real GROUP BY 1, 2")(lambda s, d: shown(D.additive(real(s, d))))
query("d8_additive_left_out", f"WITH {REAL}, w AS (SELECT *, sum(value) OVER (PARTITION BY drug, feature) AS t, count(*) OVER (PARTITION BY drug, feature) AS n FROM real) SELECT line, drug, feature, round((t - value) / (n - 1), 6) AS value FROM w WHERE n > 1")(
    lambda s, d: shown(D.additive_left_out(real(s, d)))
)
query("d6_nearest_treated", f"""WITH {REAL}, l AS (SELECT a.s_suppkey AS query, b.s_suppkey AS line, -abs(round(a.s_acctbal - b.s_acctbal, 2)) AS similarity FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey),
h AS (SELECT query, drug, l.line, row_number() OVER (PARTITION BY query, drug ORDER BY similarity DESC, l.line) AS r FROM l JOIN (SELECT DISTINCT line, drug FROM real) x USING (line))
SELECT query, drug, feature, round(avg(value), 6) AS value FROM h JOIN real USING (line, drug) WHERE r <= 2 GROUP BY 1, 2, 3""")(lambda s, d: nearest(s, d))  # fmt: skip


def nearest(s, d):
    sup = table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a, b = sup.toDF("query", "nation", "x"), sup.toDF("line", "nation", "y")
    like = a.join(b, "nation").where("query <> line").select("query", "line", (-F.abs(F.round(F.col("x") - F.col("y"), 2))).alias("similarity"))
    return shown(D.nearest_treated(real(s, d), like, 2))


query("d7_generated_deltas", f"""WITH {P.CELLS}, {BULK.format("t", "line, drug", "NOT is_control")}, {BULK.format("c", "line", "is_control")}
SELECT t.line, t.drug, feature, round(t.value - c.value, 6) AS value FROM bt t JOIN bc c USING (line, feature)""")(
    lambda s, d: shown(D.generated_deltas(D.pseudobulk(P.cells(s, d).where(~F.col("is_control")), "line", "drug"), D.pseudobulk(P.cells(s, d).where("is_control"), "line")))
)
query("d11_control_baseline", f"WITH {P.CELLS}, {BULK.format('c', 'line', 'is_control')} SELECT line AS sample, feature, round(value / sum(value) OVER (PARTITION BY line) * 1000000, 4) AS value FROM bc")(lambda s, d: control_baseline(s, d))


def control_baseline(s, d):
    from panelwright.operators.matrix import scaled

    b = D.pseudobulk(P.cells(s, d).where("is_control"), "line").withColumnRenamed("line", "sample")
    return scaled(b, 1e6).select("sample", "feature", F.round("value", 4).alias("value"))


query("a13_fidelity", f"""WITH {REAL}, w AS (SELECT *, sum(value) OVER (PARTITION BY drug, feature) AS t, count(*) OVER (PARTITION BY drug, feature) AS n FROM real), made AS (SELECT line, drug, feature, (t - value) / (n - 1) AS value FROM w WHERE n > 1),
pr AS (SELECT DISTINCT line, drug FROM made JOIN real USING (line, drug)), top AS (SELECT feature FROM real SEMI JOIN pr USING (line, drug) WHERE feature IN (SELECT feature FROM made) GROUP BY 1 ORDER BY var_pop(value) DESC, feature LIMIT 15),
grid AS (SELECT line, drug, feature FROM pr, top), x AS (SELECT g.*, coalesce(m.value, 0) AS v FROM grid g LEFT JOIN made m USING (line, drug, feature)), y AS (SELECT g.*, coalesce(m.value, 0) AS v FROM grid g LEFT JOIN real m USING (line, drug, feature)),
c AS (SELECT x.line, x.drug, (x.line = y.line AND x.drug = y.drug) AS own, coalesce(round(CASE WHEN stddev_pop(x.v) < 1e-12 OR stddev_pop(y.v) < 1e-12 THEN 0 ELSE corr(x.v, y.v) END, 9), 0) AS r FROM x JOIN y USING (feature) GROUP BY x.line, x.drug, y.line, y.drug),
o AS (SELECT line, drug, r FROM c WHERE own) SELECT o.line, o.drug, round(o.r, 6) AS r, round(avg(c.r), 6) AS r_off, round(avg(CAST(c.r < o.r AS DOUBLE)), 4) AS rank FROM o JOIN c USING (line, drug) WHERE NOT c.own GROUP BY 1, 2, o.r""")(
    lambda s, d: likeness(s, d)
)


def likeness(s, d):
    r = checkpointed(real(s, d))  # read three times
    return D.fidelity(D.additive_left_out(r), r, 15).select("line", "drug", F.round("r", 6).alias("r"), F.round("r_off", 6).alias("r_off"), F.round("rank", 4).alias("rank"))


SETS = "sets AS (SELECT DISTINCT p_brand AS feature, left(p_brand, 7) AS signature, CASE WHEN p_brand LIKE '%1' THEN -1 ELSE 1 END AS direction FROM part)"


def sets(s, d):
    return table(s, d, "part").select(F.col("p_brand").alias("feature"), F.substring("p_brand", 1, 7).alias("signature"), F.when(F.col("p_brand").like("%1"), -1).otherwise(1).alias("direction")).distinct()


query("v1_signature_scores", f"WITH {P.EXPR}, {Z}, {SETS} SELECT sample, signature, round(avg(value * direction), 6) AS score FROM z JOIN sets USING (feature) GROUP BY 1, 2")(
    lambda s, d: V.sensitivity(P.expr(s, d), sets(s, d)).select("sample", "signature", F.round("score", 6).alias("score"))
)
query("v2_mean_readout", f"WITH {P.EXPR}, {Z}, {SETS}, e AS (SELECT sample, signature, avg(value * direction) AS s FROM z JOIN sets USING (feature) GROUP BY 1, 2) SELECT sample, round(avg(s), 6) AS score FROM e GROUP BY 1")(
    lambda s, d: V.mean_readout(P.expr(s, d), sets(s, d)).select("sample", F.round("score", 6).alias("score"))
)
RULES = "rules AS (SELECT row_number() OVER (ORDER BY feature, item) AS rule, item, feature, CASE WHEN feature < item THEN -1 ELSE 1 END AS sign FROM (SELECT DISTINCT a.p_brand AS item, b.p_brand AS feature FROM part a JOIN part b ON left(a.p_brand, 7) = left(b.p_brand, 7)))"
query("mod_p6_rule_offsets", f"""WITH {P.EXPR}, {P.DENSE}, {RULES}, st AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS sd FROM expr GROUP BY 1), z AS (SELECT sample AS unit, feature, (value - m) / CASE WHEN coalesce(sd, 0) < 1e-12 THEN 1 ELSE sd END AS z FROM expr JOIN st USING (feature)),
h AS (SELECT unit, item, arg_max(z * sign, rule) AS residual FROM dense JOIN rules USING (item) JOIN z USING (unit, feature) GROUP BY 1, 2) SELECT unit, item, round(coalesce(residual, 0), 6) AS residual FROM dense LEFT JOIN h USING (unit, item)""")(lambda s, d: rules_on(s, d))  # fmt: skip


def rules_on(s, d):
    from pyspark.sql import Window as W

    b = table(s, d, "part").select("p_brand").distinct()  # a vocabulary
    pairs = b.select(F.col("p_brand").alias("item"), F.substring("p_brand", 1, 7).alias("k")).join(b.select(F.col("p_brand").alias("feature"), F.substring("p_brand", 1, 7).alias("k")), "k")
    rules = pairs.select("item", "feature", F.row_number().over(W.orderBy("feature", "item")).alias("rule"), F.when(F.col("feature") < F.col("item"), -1).otherwise(1).alias("sign"))
    return V.rule_offsets(P.dense(s, d), P.expr(s, d), rules).select("unit", "item", F.round("residual", 6).alias("residual"))


V6_DRAWS = """y AS (SELECT l_suppkey AS unit, l_returnflag || l_linestatus AS item, round(avg(l_discount), 9) AS y_true FROM lineitem GROUP BY 1, 2),
expr AS (SELECT line || ' ' || drug AS sample, line, drug, feature, value FROM real),
z AS (SELECT line AS unit, drug AS item, feature, (value - avg(value) OVER (PARTITION BY feature)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY feature) < 1e-12 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY feature) END AS z FROM expr),
have AS (SELECT DISTINCT feature FROM z), pr AS (SELECT * FROM sets WHERE feature IN (SELECT feature FROM have)), sz AS (SELECT signature, count(*) AS n_features, max(direction) AS direction FROM pr GROUP BY 1),
own AS (SELECT signature, unit, item, y_true, -avg(z * direction) AS y_pred FROM z JOIN pr USING (feature) JOIN y USING (unit, item) GROUP BY ALL),
pe AS (SELECT b, item, unit, y_true, row_number() OVER (PARTITION BY b, item ORDER BY md5('9 slot:' || b || ':' || item || ':' || unit)) AS slot, row_number() OVER (PARTITION BY b, item ORDER BY md5('9:' || b || ':' || item || ':' || unit)) AS dest FROM y, range(20) t(b)),
mi AS (SELECT a.b, a.item, a.unit, z.y_true FROM pe a JOIN pe z ON a.b = z.b AND a.item = z.item AND a.slot = z.dest),
ord AS (SELECT b, feature, row_number() OVER (PARTITION BY b ORDER BY md5('9 set:' || b || ':' || feature)) AS k FROM have, range(20) t(b)),
alls AS (SELECT 'own' AS kind, -1 AS b, signature, unit, item, y_true, y_pred FROM own UNION ALL SELECT 'label', b, signature, unit, item, mi.y_true, y_pred FROM own JOIN mi USING (unit, item)
  UNION ALL SELECT 'random', b, signature, unit, item, y_true, -avg(z * direction) FROM ord JOIN sz ON k <= n_features JOIN z USING (feature) JOIN y USING (unit, item) GROUP BY ALL),
c AS (SELECT kind, b, signature, unit, item, y_true - avg(y_true) OVER (PARTITION BY kind, b, signature, unit) AS y_true, y_pred - avg(y_pred) OVER (PARTITION BY kind, b, signature, unit) AS y_pred FROM alls)"""
query("v6_score_signatures", f"""WITH {REAL}, {SETS}, {V6_DRAWS}, {P.ranks_sql("c", "kind, b, signature, item")}, v AS (SELECT kind, b, signature, {P.RHO} AS rho FROM r GROUP BY 1, 2, 3), o AS (SELECT signature, rho AS interaction FROM v WHERE kind = 'own'),
gg AS (SELECT signature, round(y_true, 9) AS t, round(y_pred, 9) AS q FROM own), gr AS (SELECT signature, rank() OVER (PARTITION BY signature ORDER BY t) + (count(*) OVER (PARTITION BY signature, t) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY signature ORDER BY q) + (count(*) OVER (PARTITION BY signature, q) - 1) / 2.0 AS rq FROM gg),
gl AS (SELECT signature, round(corr(rt, rq), 6) AS global FROM gr GROUP BY 1)
SELECT signature, any_value(n_features) AS n_features, any_value(interaction) AS interaction, any_value(global) AS global, round(avg(CAST(rho >= interaction AS DOUBLE)) FILTER (WHERE kind = 'label'), 6) AS p_label,
  round(quantile_cont(rho, 0.95) FILTER (WHERE kind = 'random'), 6) AS rnd_p95, round(avg(CAST(rho >= interaction AS DOUBLE)) FILTER (WHERE kind = 'random'), 6) AS p_vs_random FROM v JOIN o USING (signature) JOIN sz USING (signature) JOIN gl USING (signature) GROUP BY 1""")(lambda s, d: signature_scores(s, d))  # fmt: skip


def signature_scores(s, d):
    y = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.concat("l_returnflag", "l_linestatus").alias("item")).agg(F.round(F.avg("l_discount"), 9).alias("y_true"))
    return Z6.score_signatures(real(s, d), y, sets(s, d), 20, 20, 9)
