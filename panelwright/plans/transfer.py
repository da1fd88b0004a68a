"""Queries that carry a fit from one panel to another, rank policies, and reshape labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators import metrics as M
from panelwright.operators.controls import uniform
from panelwright.operators.scores import grouped_rho
from panelwright.plans import panels as P
from panelwright.plans.registry import query
from panelwright.session import table

TWO = """a AS (SELECT l_suppkey AS unit, p_brand AS item, round(avg(l_discount), 9) AS y_true FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1, 2),
b AS (SELECT l_suppkey AS unit, p_brand AS item, round(avg(l_discount), 9) AS y_true FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2)"""


def side(s, d, flag):
    r = P.with_parts(s, d, "l_discount", "l_returnflag").where(F.col("l_returnflag") == flag)
    return r.groupBy(F.col("l_suppkey").alias("unit"), F.col("p_brand").alias("item")).agg(F.round(F.avg("l_discount"), 9).alias("y_true"))


def item_fit(s, d, least):
    """Item means of panel A where it has enough rows, the mean over all otherwise."""
    a = side(s, d, "A")
    m = a.groupBy("item").agg(F.avg("y_true").alias("m"), F.count(F.lit(1)).alias("n"))
    return m, a.agg(F.avg("y_true").alias("g"))


@query("mod_p9_frozen_transfer", f"""WITH {TWO}, m AS (SELECT item, avg(y_true) AS m, count(*) AS n FROM a GROUP BY 1), g AS (SELECT avg(y_true) AS g FROM a)
SELECT unit, item, round(y_true, 6) AS y_true, round(CASE WHEN n >= 10 THEN m ELSE g END, 6) AS y_pred FROM b LEFT JOIN m USING (item), g""")  # fmt: skip
def p9(s, d):
    m, g = item_fit(s, d, 10)
    b = side(s, d, "R").join(m, "item", "left").crossJoin(F.broadcast(g))
    return b.select("unit", "item", F.round("y_true", 6).alias("y_true"), F.round(F.when(F.col("n") >= 10, F.col("m")).otherwise(F.col("g")), 6).alias("y_pred"))


query("r4_pairs_across", f"WITH {TWO} SELECT unit, item, round(a.y_true, 6) AS x, round(b.y_true, 6) AS y FROM a JOIN b USING (unit, item)")(
    lambda s, d: side(s, d, "A").withColumnRenamed("y_true", "x").join(side(s, d, "R").withColumnRenamed("y_true", "y"), ["unit", "item"]).select("unit", "item", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
)


@query("mod_p12_offset_policy", f"""WITH {P.DENSE}, o AS (SELECT unit, item, y_pred + CASE WHEN item LIKE '%1' THEN -1000000 WHEN item LIKE '%5' THEN 1000000 ELSE 0 END AS score FROM dense)
SELECT unit, arg_min(item, (score, item)) AS item FROM o GROUP BY 1""")  # fmt: skip
def p12(s, d):
    off = F.when(F.col("item").like("%1"), -1e6).when(F.col("item").like("%5"), 1e6).otherwise(0.0)
    return P.dense(s, d).withColumn("score", F.col("y_pred") + off).groupBy("unit").agg(F.min_by("item", F.struct("score", "item")).alias("item"))


@query("mod_p13_random_policy", f"""WITH {P.DENSE}, r AS (SELECT b, unit, item, y_true, (CAST('0x' || left(md5('4:' || b || ':' || unit || ':' || item), 12) AS BIGINT) + 0.5) AS k FROM dense, range(5) t(b)),
p AS (SELECT b, unit, arg_min(y_true, (k, item)) AS got, min(y_true) AS lo, max(y_true) AS hi FROM r GROUP BY 1, 2) SELECT b, round(avg((got - lo) / (hi - lo)), 6) AS regret FROM p WHERE hi > lo GROUP BY 1""")  # fmt: skip
def p13(s, d):
    p = P.dense(s, d).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(4))))
    p = p.select("b", "unit", "item", "y_true", uniform(4, "b", F.col("unit").cast("string"), "item").alias("y_pred"))
    return M.regret_by_unit(p, 1, "b").groupBy("b").agg(F.round(F.avg("regret"), 6).alias("regret"))


@query("a31_rule_correlations", f"""WITH {P.DENSE}, f AS (SELECT s_suppkey AS unit, s_acctbal AS x FROM supplier), j AS (SELECT item, round(x, 9) AS t, round(y_true, 9) AS q FROM dense JOIN f USING (unit)),
r AS (SELECT item, rank() OVER (PARTITION BY item ORDER BY t) + (count(*) OVER (PARTITION BY item, t) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY item ORDER BY q) + (count(*) OVER (PARTITION BY item, q) - 1) / 2.0 AS rq FROM j),
c AS (SELECT item, round(CASE WHEN stddev_pop(rt) > 0 AND stddev_pop(rq) > 0 THEN corr(rt, rq) END, 6) AS rho, CASE WHEN item LIKE '%1' THEN -1 ELSE 1 END AS direction FROM r GROUP BY 1) SELECT item, rho, direction, rho * direction > 0 AS fits FROM c""")  # fmt: skip
def a31_rho(s, d):
    """A rule an item with the direction it expects: Spearman's correlation of the units' balance with the response, and whether its sign fits."""
    f = table(s, d, "supplier").select(F.col("s_suppkey").alias("unit"), "s_acctbal")
    rho = grouped_rho(P.dense(s, d).join(f, "unit"), ["item"], "s_acctbal", "y_true", "rho")
    return rho.withColumn("direction", F.when(F.col("item").like("%1"), -1).otherwise(1)).select("item", "rho", "direction", (F.col("rho") * F.col("direction") > 0).alias("fits"))


@query("a31_rule_table", f"""WITH {P.DENSE}, f AS (SELECT s_suppkey AS unit, s_acctbal > 5000 AS pos FROM supplier),
u AS (SELECT unit, item, y_true, (rank() OVER (PARTITION BY unit ORDER BY y_true) - 1) / CAST(count(*) OVER (PARTITION BY unit) AS DOUBLE) AS pct FROM dense)
SELECT item, count(*) AS n, CAST(sum(CAST(pos AS INTEGER)) AS BIGINT) AS n_pos, round(avg(CASE WHEN pos THEN y_true END) - avg(CASE WHEN NOT pos THEN y_true END), 6) AS shift, round(avg(CASE WHEN pos THEN pct END), 6) AS percentile FROM u JOIN f USING (unit) GROUP BY 1""")  # fmt: skip
def a31(s, d):
    w = W.partitionBy("unit")
    u = P.dense(s, d).withColumn("pct", (F.rank().over(w.orderBy("y_true")) - 1) / F.count(F.lit(1)).over(w))
    f = table(s, d, "supplier").select(F.col("s_suppkey").alias("unit"), (F.col("s_acctbal") > 5000).alias("pos"))
    g = u.join(f, "unit").groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("int")).alias("n_pos"),
        F.round(F.avg(F.when(F.col("pos"), F.col("y_true"))) - F.avg(F.when(~F.col("pos"), F.col("y_true"))), 6).alias("shift"), F.round(F.avg(F.when(F.col("pos"), F.col("pct"))), 6).alias("percentile"),
    )
    return g


@query("r5_two_hop_keys", """SELECT n_name AS line, p_type AS drug, round(avg(l_discount), 6) AS y, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def r5(s, d):
    sup = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("line"))
    rows = P.with_parts(s, d, "l_discount").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("line", F.col("p_type").alias("drug")).agg(F.round(F.avg("l_discount"), 6).alias("y"), F.count(F.lit(1)).alias("n"))


@query("r23_aliases", """WITH t AS (SELECT term_id, lower(term_name) AS name, term_name FROM ref_terms WHERE field_name = 'drug_name'), al AS (SELECT term_id, lower(trim(unnest(string_split(synonyms, ';')), ' ')) AS name FROM ref_terms WHERE field_name = 'drug_name' AND synonyms IS NOT NULL),
one AS (SELECT name, min(term_id) AS term_id FROM al GROUP BY 1 HAVING count(DISTINCT term_id) = 1), v AS (SELECT DISTINCT lower(trim(drug_name, ' ')) AS name FROM drug_assays)
SELECT v.name, coalesce(t.term_id, one.term_id) AS term_id, CASE WHEN t.term_id IS NOT NULL THEN 'name' WHEN one.term_id IS NOT NULL THEN 'alias' END AS via FROM v LEFT JOIN t USING (name) LEFT JOIN one USING (name) WHERE coalesce(t.term_id, one.term_id) IS NOT NULL""")  # fmt: skip
def r23(s, d):
    terms = table(s, d, "ref_terms").where("field_name = 'drug_name'")
    direct = terms.select(F.lower("term_name").alias("name"), F.col("term_id").alias("d"))
    alias = terms.where("synonyms IS NOT NULL").select("term_id", F.explode(F.split("synonyms", ";")).alias("x")).groupBy(F.lower(F.trim("x")).alias("name"))
    alias = alias.agg(F.min("term_id").alias("a"), F.countDistinct("term_id").alias("k")).where("k = 1").drop("k")
    v = table(s, d, "drug_assays").select(F.lower(F.trim("drug_name")).alias("name")).distinct().join(direct, "name", "left").join(alias, "name", "left")
    return v.select("name", F.coalesce("d", "a").alias("term_id"), F.when(F.col("d").isNotNull(), "name").when(F.col("a").isNotNull(), "alias").alias("via")).where("term_id IS NOT NULL")
