"""Further queries: merged means, ranks and heads, id maps, measured and conditional deltas, transfer with fallbacks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.ranks import group_avg_rank, with_group
from panelwright.operators import controls as C
from panelwright.operators import deltas as D
from panelwright.operators import matrix as X
from panelwright.operators import metrics as M
from panelwright.operators import models as L
from panelwright.operators import relational as R
from panelwright.operators import signatures as V
from panelwright.operators import splits as S
from panelwright.plans import panels as P
from panelwright.plans.deltas import SETS, sets, shown
from panelwright.plans.matrix import Z
from panelwright.plans.models import FOLD, features, item_features
from panelwright.plans.registry import query
from panelwright.plans.transfer import side
from panelwright.session import checkpointed, table, vocabulary

query("a2_merged_means", "SELECT l_partkey, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")(
    lambda s, d: R.merged_means(table(s, d, "lineitem"), ["l_partkey"], "l_returnflag", "l_quantity").select("l_partkey", "n", F.round("mean", 6).alias("mean"))
)
query("a5_pooled_means", "SELECT l_suppkey, l_returnflag, round(avg(l_tax), 6) AS mean FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2")(
    lambda s, d: table(s, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_tax"), 6).alias("mean"))
)
query("a14_row_correlations", f"WITH {P.DENSE} SELECT unit, round(CASE WHEN stddev_pop(y_true) < 1e-12 OR stddev_pop(y_pred) < 1e-12 THEN 0.0 ELSE corr(y_true, y_pred) END, 6) AS r FROM dense GROUP BY 1")(
    lambda s, d: M.row_correlations(P.dense(s, d), "unit").select("unit", F.round("r", 6).alias("r"))
)
query("a26_quantiles", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY 1")(
    lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_extendedprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    .select("l_suppkey", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])
)

LINES = "SELECT l_orderkey, l_linenumber, {} AS rank FROM lineitem"
TIES = "(rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_partkey, l_quantity) - 1) / 2.0)"
query("w2_average_tie_rank", LINES.format(TIES))(lambda s, d: group_avg_rank(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_partkey"], {"l_quantity": "rank"}).select("l_orderkey", "l_linenumber", "rank"))
query("w3_percentile_rank", LINES.format(f"round({TIES} / count(l_quantity) OVER (PARTITION BY l_partkey), 9)"))(
    lambda s, d: group_avg_rank(with_group(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_partkey"], n=F.count("l_quantity")), ["l_partkey"], {"l_quantity": "r"}).select("l_orderkey", "l_linenumber", F.round(F.col("r") / F.col("n"), 9).alias("rank"))
)
query("w6_head_of_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3")(
    lambda s, d: table(s, d, "orders").select("o_custkey", "o_orderkey").withColumn("r", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).where("r <= 3").drop("r")
)
query("w7_group_size", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")(lambda s, d: with_group(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], n=F.count(F.lit(1))).select("o_orderkey", "n"))
query("o1_sorted_nulls_last", "SELECT lang, n_chars, doc_id FROM documents ORDER BY lang NULLS LAST, n_chars NULLS LAST, doc_id")(
    lambda s, d: table(s, d, "documents").select("lang", "n_chars", "doc_id").orderBy(F.asc_nulls_last("lang"), F.asc_nulls_last("n_chars"), "doc_id")
)
query("o3_row_top_k", f"WITH {P.DENSE} SELECT unit, item FROM (SELECT unit, item, row_number() OVER (PARTITION BY unit ORDER BY y_pred DESC, item) AS r FROM dense) WHERE r <= 3")(
    lambda s, d: P.dense(s, d).withColumn("r", F.row_number().over(W.partitionBy("unit").orderBy(F.desc("y_pred"), "item"))).where("r <= 3").select("unit", "item")
)


@query("n14_dense_rows", """SELECT expression_matrix_uri AS uri, position - 1 AS position, CAST(profile[position] AS DOUBLE) AS value FROM expression_profiles, generate_series(1, 64) g(position)
WHERE len(profile) = 64 AND len(list_filter(profile, lambda y: y IS NULL OR isnan(y))) = 0""")  # fmt: skip
def dense_rows(s, d):
    """Rows of full length in single precision; a row with a missing entry is refused, not filled."""
    p = table(s, d, "expression_profiles").where((F.size("profile") == 64) & ~F.exists("profile", lambda y: y.isNull() | F.isnan(y)))
    return p.select(F.col("expression_matrix_uri").alias("uri"), F.posexplode(F.transform("profile", lambda y: y.cast("float"))).alias("position", "value")).withColumn("value", F.col("value").cast("double"))


query("s11_id_map", "SELECT DISTINCT trim(source_drug_id) AS name, pubchem_cid FROM drug_xref WHERE trim(source_drug_id) <> '' AND pubchem_cid IS NOT NULL")(
    lambda s, d: table(s, d, "drug_xref").select(F.trim("source_drug_id").alias("name"), "pubchem_cid").where("name <> '' AND pubchem_cid IS NOT NULL").distinct()
)
query("s14_listed_ids", "SELECT id, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(notes, '[ \\t\\r\\n]+')) AS id FROM drug_xref) WHERE id <> '' GROUP BY 1")(
    lambda s, d: table(s, d, "drug_xref").select(F.explode(F.split("notes", "[ \\t\\r\\n]+")).alias("id")).where("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
)


@query("f11_resolved_stems", """WITH ids AS (SELECT input_name AS name, min(xref_id) AS id FROM drug_xref WHERE input_name IS NOT NULL GROUP BY 1),
o AS (SELECT source_drug_id AS name, min(xref_id) AS id FROM drug_xref WHERE source_drug_id IS NOT NULL GROUP BY 1), s AS (SELECT DISTINCT drug_name AS stem FROM drug_assays WHERE drug_name IS NOT NULL)
SELECT stem, coalesce(a.id, b.id, c.id) AS id FROM s LEFT JOIN ids a ON a.name = stem LEFT JOIN ids b ON b.name = replace(stem, '_', ' ') LEFT JOIN o c ON c.name = stem""")  # fmt: skip
def stems(s, d):
    x = table(s, d, "drug_xref")
    ids, further = (x.select(F.col(c).alias("name"), F.col("xref_id").alias("id")) for c in ("input_name", "source_drug_id"))
    return R.resolved_stems(table(s, d, "drug_assays").where("drug_name IS NOT NULL").select(F.col("drug_name").alias("stem")), ids, further)


@query("r28_picked_column", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def picked(s, d):
    o = table(s, d, "orders")
    return o.groupBy(F.col(R.picked(o, ["status", "order_status", "o_orderstatus"])).alias("status")).agg(F.count(F.lit(1)).alias("n"))


SCHEMES = {"5fold": lambda p: S.hashed_folds(p, 5), "loo": lambda p: S.leave_key_out(p, "unit")}
query("x7_schemes", f"WITH {P.DENSE} SELECT DISTINCT '5fold' AS scheme, unit, CAST({FOLD} AS VARCHAR) AS fold FROM dense UNION ALL SELECT DISTINCT 'loo', unit, CAST(unit AS VARCHAR) FROM dense")(lambda s, d: schemes(s, d))


def schemes(s, d):
    a, b = (f(P.dense(s, d)).select(F.lit(n).alias("scheme"), "unit", F.col("fold").cast("string").alias("fold")) for n, f in SCHEMES.items())
    return a.unionByName(b)


def wells(s, d):
    return P.cells(s, d).withColumnRenamed("plate", "replicate")


query("d3_measured_pairs", f"""WITH {P.CELLS}, k AS (SELECT DISTINCT line, drug, plate FROM cells), c AS (SELECT line, drug, plate FROM (SELECT *, row_number() OVER (PARTITION BY line, drug ORDER BY plate) AS r FROM k) WHERE r <= 40),
y AS (SELECT symbol, min(feature) AS feature FROM (SELECT DISTINCT p_brand AS feature, substr(p_brand, 7, 1) AS symbol FROM part) WHERE symbol <> '' GROUP BY 1),
m AS (SELECT cells.line, cells.drug, is_control, symbol, avg(value) AS value FROM cells JOIN c USING (line, drug, plate) JOIN y USING (feature) GROUP BY 1, 2, 3, 4)
SELECT t.line, t.drug, t.symbol AS feature, round(t.value - b.value, 6) AS value FROM m t JOIN m b ON t.line = b.line AND t.symbol = b.symbol AND b.is_control WHERE NOT t.is_control""")(
    lambda s, d: shown(D.measured_pairs(wells(s, d), table(s, d, "part").select(F.col("p_brand").alias("feature"), F.substring("p_brand", 7, 1).alias("symbol")).distinct(), 40))
)
query("d9_global_deltas_read", f"""WITH {P.CELLS}, t AS (SELECT drug, feature, avg(value) AS v FROM cells WHERE NOT is_control GROUP BY 1, 2), c AS (SELECT feature, avg(value) AS b FROM cells WHERE is_control GROUP BY 1),
expr AS (SELECT drug AS sample, feature, v - b AS value FROM t JOIN c USING (feature)), {Z}, {SETS} SELECT sample AS drug, signature, round(avg(value * direction), 6) AS score FROM z JOIN sets USING (feature) GROUP BY 1, 2""")(
    lambda s, d: V.sensitivity(D.global_deltas(P.cells(s, d)).withColumnRenamed("drug", "sample"), sets(s, d)).select(F.col("sample").alias("drug"), "signature", F.round("score", 6).alias("score"))
)
query("d12_filled_by_drug", f"""WITH {P.CELLS}, m AS (SELECT drug, line, feature, avg(value) AS value FROM cells GROUP BY 1, 2, 3), g AS (SELECT * FROM (SELECT DISTINCT drug, line FROM m) JOIN (SELECT DISTINCT drug, feature FROM m) USING (drug))
SELECT drug, line, feature, round(coalesce(value, 0), 6) AS value FROM g LEFT JOIN m USING (drug, line, feature)""")(
    lambda s, d: shown(D.filled_by_drug(P.cells(s, d).groupBy("drug", "line", "feature").agg(F.avg("value").alias("value"))))
)


@query("d10_conditional_deltas")
def conditional(s, d):
    """Deltas for the lines as another measure describes them: their mean prices by brand."""
    base = P.with_parts(s, d, "l_extendedprice").groupBy(F.col("l_suppkey").alias("line"), F.col("p_brand").alias("feature")).agg(F.avg("l_extendedprice").alias("value"))
    names = vocabulary(table(s, d, "part"), "p_brand", L.MAX_FEATURES)
    asked = P.cells(s, d).where(~F.col("is_control")).select("line", "drug")
    return shown(D.conditional_deltas(P.cells(s, d), base, asked, names, 5))


@query("mod_p10_transfer_by_item")
def transfer_by_item(s, d):
    """A ridge for each item of panel A with ten units or more, carried to panel R; else the item's mean in A; else a score that comes last."""
    x = checkpointed(features(s, d))
    a = checkpointed(side(s, d, "A"))
    rows = a.join(x, "unit").join(S.hashed_folds(a, 5), "unit")
    w = L.fitted(rows, ["item"], "x", "y_true", "fold", min_n=10).select("item", "w")
    means = a.groupBy("item").agg(F.avg("y_true").alias("m"))
    out = side(s, d, "R").join(x, "unit", "left").join(w, "item", "left").join(means, "item", "left")
    return out.select("unit", "item", F.round("y_true", 6).alias("y_true"), F.round(F.coalesce(L.predicted(), F.col("m"), F.lit(1e6)), 6).alias("y_pred"))


@query("mod_p11_bilinear_transfer")
def bilinear_transfer(s, d):
    """One ridge on unit features, item features and their products, fitted on panel A and carried to panel R."""
    x, g = checkpointed(features(s, d, 3)), item_features(s, d)
    a, r = (side(s, d, flag).join(x, "unit").join(g, "item").withColumn("x", X.bilinear(F.col("x"), F.col("g"))) for flag in ("A", "R"))
    a = checkpointed(a)
    w = L.fitted(a.join(S.hashed_folds(a, 5), "unit"), [], "x", "y_true", "fold")  # one row
    return r.crossJoin(F.broadcast(w)).select("unit", "item", F.round("y_true", 6).alias("y_true"), F.round(L.predicted(), 6).alias("y_pred"))


@query("c6_shared_direction")
def shared_direction(s, d):
    """Two cohorts given one direction, which items carry by their shared key: the interaction that each shows."""
    two = [C.planted(side(s, d, f).withColumn("y_pred", F.lit(0.0)), 0.02, 0.01, 11).withColumn("cohort", F.lit(f)) for f in ("A", "R")]
    return M.interaction_rho(two[0].unionByName(two[1]), "cohort").select("cohort", F.round("interaction_rho", 6).alias("interaction_rho"))
