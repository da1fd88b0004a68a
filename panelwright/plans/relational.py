"""Queries of the relational core, the design and the sources that are tables here."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.ranks import leave_one_out_mean
from panelwright.operators import relational as R
from panelwright.plans import panels as P
from panelwright.plans.registry import query
from panelwright.session import table, vocabulary
from panelwright.sources import readers

PID = r"regexp_replace(regexp_replace(upper(regexp_replace({}, '\s+', '', 'g')), '_(TUMOR|ORGANOIDS?)$', ''), '^([A-Z]+)[-_]+([0-9])', '\1\2')"


def pid(c):
    bare = F.regexp_replace(F.upper(F.regexp_replace(c, r"\s+", "")), "_(TUMOR|ORGANOIDS?)$", "")
    return F.regexp_replace(bare, "^([A-Z]+)[-_]+([0-9])", "$1$2")


DESIGN = f"""design AS (SELECT p.patient AS unit, coalesce(CAST(nullif(a.pubchem_cid, 0) AS VARCHAR), a.drug_id) AS item, round(avg(a.response_value), 9) AS y
  FROM (SELECT DISTINCT assay_id, sample_id, drug_id, pubchem_cid, response_metric, response_value FROM drug_assays) a
  JOIN (SELECT DISTINCT sample_id, {PID.format("patient_id")} AS patient FROM samples WHERE patient_id IS NOT NULL) p USING (sample_id)
  WHERE response_metric = 'auc' AND response_value IS NOT NULL AND CAST(response_value AS VARCHAR) <> 'nan'
    AND sample_id IN (SELECT sample_id FROM baseline_expression JOIN expression_profiles USING (expression_matrix_uri) WHERE profile IS NOT NULL)
  GROUP BY 1, 2)"""


def design(s, d, metric="auc"):
    """(unit, item, y): the mean response of every patient and drug, of samples with a profile, one metric."""
    assays = table(s, d, "drug_assays").select("assay_id", "sample_id", "drug_id", "pubchem_cid", "response_metric", "response_value").where(
        (F.col("response_metric") == metric) & F.col("response_value").isNotNull() & ~F.isnan("response_value")
    )
    profiled = table(s, d, "baseline_expression").join(table(s, d, "expression_profiles").where("profile IS NOT NULL"), "expression_matrix_uri", "left_semi").select("sample_id")
    patients = table(s, d, "samples").where("patient_id IS NOT NULL").select("sample_id", pid(F.col("patient_id")).alias("unit")).distinct()
    rows = assays.distinct().join(profiled, "sample_id", "left_semi").join(patients, "sample_id")
    item = F.coalesce(F.when(F.col("pubchem_cid") != 0, F.col("pubchem_cid").cast("string")), F.col("drug_id"))
    return rows.groupBy("unit", item.alias("item")).agg(F.round(F.avg("response_value"), 9).alias("y"))


query("r1_design", f"WITH {DESIGN} SELECT unit, item, round(y, 6) AS y FROM design")(lambda s, d: design(s, d).select("unit", "item", F.round("y", 6).alias("y")))
query("r2_scores_with_labels", f"""WITH {DESIGN}, pr AS (SELECT sample_id, drug_id, max(predicted_value) AS q FROM predictions WHERE CAST(predicted_value AS VARCHAR) NOT IN ('nan', 'inf', '-inf') GROUP BY 1, 2),
sp AS (SELECT DISTINCT sample_id, {PID.format("patient_id")} AS unit FROM samples WHERE patient_id IS NOT NULL), q AS (SELECT unit, drug_id AS item, max(q) AS q FROM pr JOIN sp USING (sample_id) GROUP BY 1, 2)
SELECT unit, item, round(y, 6) AS y, q FROM design JOIN q USING (unit, item)""")(lambda s, d: scores_with_labels(s, d, "inner"))  # fmt: skip
query("r3_labels_kept", f"""WITH {DESIGN}, pr AS (SELECT sample_id, drug_id, max(predicted_value) AS q FROM predictions WHERE CAST(predicted_value AS VARCHAR) NOT IN ('nan', 'inf', '-inf') GROUP BY 1, 2),
sp AS (SELECT DISTINCT sample_id, {PID.format("patient_id")} AS unit FROM samples WHERE patient_id IS NOT NULL), q AS (SELECT unit, drug_id AS item, max(q) AS q FROM pr JOIN sp USING (sample_id) GROUP BY 1, 2)
SELECT unit, item, round(y, 6) AS y, q FROM design LEFT JOIN q USING (unit, item)""")(lambda s, d: scores_with_labels(s, d, "left"))  # fmt: skip


def scores_with_labels(s, d, how):
    q = table(s, d, "predictions").where("predicted_value IS NOT NULL AND NOT isnan(predicted_value)").where(F.abs("predicted_value") != float("inf"))
    units = table(s, d, "samples").where("patient_id IS NOT NULL").select("sample_id", pid(F.col("patient_id")).alias("unit")).distinct()
    best = q.groupBy("sample_id", "drug_id").agg(F.max("predicted_value").alias("q")).join(units, "sample_id").groupBy("unit", F.col("drug_id").alias("item")).agg(F.max("q").alias("q"))
    return design(s, d).join(best, ["unit", "item"], how).select("unit", "item", F.round("y", 6).alias("y"), "q")


@query("r6_screens_compared", """WITH a AS (SELECT DISTINCT assay_id, sample_id, pubchem_cid, left(drug_id, 3) AS lab, response_value FROM drug_assays WHERE response_metric = 'auc' AND CAST(response_value AS VARCHAR) <> 'nan' AND pubchem_cid > 0),
m AS (SELECT lab, pubchem_cid, avg(response_value) AS y FROM a GROUP BY 1, 2)
SELECT x.lab AS lab_a, y.lab AS lab_b, count(*) AS n, round(avg(x.y - y.y), 6) AS shift FROM m x JOIN m y USING (pubchem_cid) WHERE x.lab < y.lab GROUP BY 1, 2""")  # fmt: skip
def r6(s, d):
    a = table(s, d, "drug_assays").where("response_metric = 'auc' AND NOT isnan(response_value) AND pubchem_cid > 0")
    a = a.select("assay_id", "sample_id", "pubchem_cid", F.substring("drug_id", 1, 3).alias("lab"), "response_value").distinct()
    m = a.groupBy("lab", "pubchem_cid").agg(F.avg("response_value").alias("y"))
    x, y = m.withColumnsRenamed({"lab": "lab_a", "y": "a"}), m.withColumnsRenamed({"lab": "lab_b", "y": "b"})
    return x.join(y, ["pubchem_cid"]).where("lab_a < lab_b").groupBy("lab_a", "lab_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("shift"))


query("r7_preferred_metric", """WITH c AS (SELECT sample_id, response_metric, avg(response_value) AS y FROM drug_assays WHERE CAST(response_value AS VARCHAR) <> 'nan' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY CASE response_metric WHEN 'auc' THEN 0 WHEN 'aac' THEN 1 WHEN 'ic50' THEN 2 ELSE 3 END, response_metric) AS k FROM c)
SELECT sample_id, response_metric, round(y, 6) AS y FROM r WHERE k = 1""")(lambda s, d: preferred(s, d))  # fmt: skip


def preferred(s, d):
    c = table(s, d, "drug_assays").where("NOT isnan(response_value)").groupBy("sample_id", "response_metric").agg(F.avg("response_value").alias("y"))
    order = F.when(F.col("response_metric") == "auc", 0).when(F.col("response_metric") == "aac", 1).when(F.col("response_metric") == "ic50", 2).otherwise(3)
    return R.keep_first(c, ["sample_id"], [order, "response_metric"]).select("sample_id", "response_metric", F.round("y", 6).alias("y"))


PREFERENCE = ["auc", "aac", "ic50", "dss", "viability"]
query("r7_shared_metric", """WITH h AS (SELECT DISTINCT left(drug_id, 3) AS lab, response_metric FROM drug_assays WHERE drug_id IS NOT NULL AND CAST(response_value AS VARCHAR) <> 'nan'),
p AS (SELECT a.lab AS lab_a, b.lab AS lab_b, a.response_metric AS metric, list_position(['auc', 'aac', 'ic50', 'dss', 'viability'], a.response_metric) AS k FROM h a JOIN h b ON a.response_metric = b.response_metric AND a.lab < b.lab)
SELECT lab_a, lab_b, arg_min(metric, k) AS metric FROM p WHERE k > 0 GROUP BY 1, 2""")(lambda s, d: shared_metric(s, d))  # fmt: skip


def shared_metric(s, d):
    """For each two laboratories, the first metric in the order of preference that both have measured."""
    h = table(s, d, "drug_assays").where("drug_id IS NOT NULL AND NOT isnan(response_value)").select(F.substring("drug_id", 1, 3).alias("lab"), F.col("response_metric").alias("metric")).distinct()
    p = h.withColumnRenamed("lab", "lab_a").join(h.withColumnRenamed("lab", "lab_b"), "metric").where("lab_a < lab_b")
    k = F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("metric"))
    return p.where(k > 0).groupBy("lab_a", "lab_b").agg(F.min_by("metric", k).alias("metric"))


@query("s17_cohorts", """WITH c AS (SELECT unnest(['alden', 'brevikpdo', 'Corrin', 'dunmore']) AS asked, unnest(['aldenscreen', 'brevikpdo', 'corrincell', 'dunmorelab']) AS name)
SELECT asked, (SELECT count(*) FROM patients WHERE tranche_id LIKE 'cohort_' || name || '_%') AS patients, (SELECT count(*) FROM samples WHERE tranche_id LIKE 'cohort_' || name || '_%') AS samples,
  (SELECT count(*) FROM drug_assays WHERE sample_id IN (SELECT sample_id FROM samples WHERE tranche_id LIKE 'cohort_' || name || '_%')) AS assays FROM c""")  # fmt: skip
def cohorts(s, d):
    """Tables of the registered collections, asked by name or alias."""
    out = None
    for asked in ("alden", "brevikpdo", "Corrin", "dunmore"):
        t = readers.load("cohort", s, d, asked)
        sizes = [t[n].agg(F.count(F.lit(1)).alias(c)) for n, c in (("patients", "patients"), ("samples", "samples"), ("drug_assays", "assays"))]
        one = sizes[0].crossJoin(F.broadcast(sizes[1])).crossJoin(F.broadcast(sizes[2])).select(F.lit(asked).alias("asked"), "patients", "samples", "assays")
        out = one if out is None else out.unionByName(one)
    return out


query("r8_semi", "SELECT DISTINCT sample_id FROM samples WHERE sample_id IN (SELECT sample_id FROM baseline_expression)")(
    lambda s, d: table(s, d, "samples").join(table(s, d, "baseline_expression"), "sample_id", "left_semi").select("sample_id").distinct()
)
query("r9_anti", "SELECT DISTINCT sample_id FROM drug_assays WHERE sample_id NOT IN (SELECT sample_id FROM samples WHERE sample_id IS NOT NULL)")(
    lambda s, d: table(s, d, "drug_assays").join(table(s, d, "samples"), "sample_id", "left_anti").select("sample_id").distinct()
)
query("r10_intersect", "SELECT drug_id FROM drug_assays INTERSECT SELECT drug_id FROM predictions")(lambda s, d: table(s, d, "drug_assays").select("drug_id").intersect(table(s, d, "predictions").select("drug_id")))
query("r11_union_by_name", """SELECT lab, sum(assays) AS assays, sum(predicted) AS predicted FROM (SELECT left(drug_id, 3) AS lab, 1 AS assays, 0 AS predicted FROM drug_assays UNION ALL SELECT left(drug_id, 3), 0, 1 FROM predictions) GROUP BY 1""")(
    lambda s, d: table(s, d, "drug_assays").select(F.substring("drug_id", 1, 3).alias("lab"), F.lit(1).alias("assays")).unionByName(table(s, d, "predictions").select(F.substring("drug_id", 1, 3).alias("lab"), F.lit(1).alias("predicted")), allowMissingColumns=True)
    .fillna(0).groupBy("lab").agg(F.sum("assays").alias("assays"), F.sum("predicted").alias("predicted"))
)
query("r12_union_distinct", "SELECT sample_id FROM samples UNION SELECT sample_id FROM drug_assays")(lambda s, d: table(s, d, "samples").select("sample_id").union(table(s, d, "drug_assays").select("sample_id")).distinct())
query("r13_except", "SELECT drug_id FROM predictions EXCEPT SELECT drug_id FROM drug_assays")(lambda s, d: table(s, d, "predictions").select("drug_id").subtract(table(s, d, "drug_assays").select("drug_id")))
query("r14_keep_first", """SELECT assay_id, sample_id, drug_id, epoch_us(ingested_at) AS ingested_us FROM (SELECT *, row_number() OVER (PARTITION BY assay_id ORDER BY ingested_at, sample_id, drug_id) AS k FROM drug_assays) WHERE k = 1""")(
    lambda s, d: R.keep_first(table(s, d, "drug_assays"), ["assay_id"], ["ingested_at", "sample_id", "drug_id"]).select("assay_id", "sample_id", "drug_id", F.unix_micros("ingested_at").alias("ingested_us"))
)
query("r15_keep_first_nulls_last", """SELECT source_drug_id, xref_id, inchikey FROM (SELECT *, row_number() OVER (PARTITION BY source_drug_id ORDER BY inchikey NULLS LAST, xref_id) AS k FROM drug_xref WHERE source_drug_id IS NOT NULL) WHERE k = 1""")(
    lambda s, d: R.keep_first(table(s, d, "drug_xref").where("source_drug_id IS NOT NULL"), ["source_drug_id"], [F.col("inchikey").asc_nulls_last(), "xref_id"]).select("source_drug_id", "xref_id", "inchikey")
)
query("r15_conflicts", """SELECT pubchem_cid, list_sort(list(DISTINCT source)) AS "values" FROM drug_xref WHERE pubchem_cid > 0 GROUP BY 1 HAVING count(DISTINCT source) > 1""")(
    lambda s, d: R.conflicts(table(s, d, "drug_xref").where("pubchem_cid > 0"), "pubchem_cid", "source")
)
BRANDS = {f"Brand#{i}": f"b{i}" for i in range(1, 26)}
query("r16_pivot", "SELECT l_suppkey AS sample, " + ", ".join(f"coalesce(round(avg(l_quantity) FILTER (WHERE p_brand = '{b}'), 6), 0) AS {n}" for b, n in BRANDS.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")(lambda s, d: pivoted(s, d))


def pivoted(s, d):
    """A column for each brand, the mean quantity, 0 where a supplier has none of it."""
    wide = P.with_parts(s, d, "l_quantity").groupBy(F.col("l_suppkey").alias("sample")).pivot("p_brand", list(BRANDS)).avg("l_quantity").fillna(0)
    return wide.select("sample", *[F.round(F.col(f"`{b}`"), 6).alias(n) for b, n in BRANDS.items()])


query("r17_overlap_report", """SELECT pubchem_cid, string_agg(DISTINCT input_name, ', ' ORDER BY input_name) FILTER (WHERE source = 'chemdesk') AS chemdesk, string_agg(DISTINCT input_name, ', ' ORDER BY input_name) FILTER (WHERE source = 'lumenbase') AS lumenbase,
string_agg(DISTINCT input_name, ', ' ORDER BY input_name) FILTER (WHERE source = 'pharmindex') AS pharmindex FROM drug_xref WHERE pubchem_cid > 0 GROUP BY 1""")(
    lambda s, d: R.overlap_report(table(s, d, "drug_xref").where("pubchem_cid > 0"), "pubchem_cid", "source", "input_name", ["chemdesk", "lumenbase", "pharmindex"])
)
query("r18_first_known", """SELECT drug_id, arg_min(inchikey, assay_id) FILTER (WHERE inchikey IS NOT NULL) AS inchikey FROM drug_assays GROUP BY 1""")(
    lambda s, d: table(s, d, "drug_assays").groupBy("drug_id").agg(F.min_by("inchikey", F.when(F.col("inchikey").isNotNull(), F.col("assay_id"))).alias("inchikey"))
)


@query("r19_lookup_by_name", """WITH f AS (SELECT lower(input_name) AS name, source, arg_min(pubchem_cid, xref_id) AS first_cid, arg_max(pubchem_cid, xref_id) AS last_cid FROM drug_xref WHERE pubchem_cid IS NOT NULL AND input_name IS NOT NULL GROUP BY 1, 2)
SELECT DISTINCT a.drug_name, source, first_cid, last_cid FROM drug_assays a JOIN f ON lower(a.drug_name) = f.name""")  # fmt: skip
def r19(s, d):
    f = table(s, d, "drug_xref").where("pubchem_cid IS NOT NULL AND input_name IS NOT NULL").groupBy(F.lower("input_name").alias("name"), "source")
    f = f.agg(F.min_by("pubchem_cid", "xref_id").alias("first_cid"), F.max_by("pubchem_cid", "xref_id").alias("last_cid"))
    return table(s, d, "drug_assays").select("drug_name", F.lower("drug_name").alias("name")).distinct().join(f, "name").drop("name")


@query("r20_fallback_join", """WITH k AS (SELECT DISTINCT drug_id, pubchem_cid AS cid, left(upper(trim(inchikey, ' ')), 14) AS block FROM drug_assays WHERE pubchem_cid > 0),
c AS (SELECT pubchem_cid AS cid, min(xref_id) AS x FROM drug_xref WHERE pubchem_cid > 0 GROUP BY 1), b AS (SELECT left(upper(trim(inchikey, ' ')), 14) AS block, min(xref_id) AS x FROM drug_xref WHERE inchikey IS NOT NULL GROUP BY 1)
SELECT drug_id, k.cid, k.block, coalesce(c.x, b.x) AS xref_id FROM k LEFT JOIN c ON k.cid = c.cid LEFT JOIN b ON k.block = b.block""")  # fmt: skip
def r20(s, d):
    block = F.substring(F.upper(F.trim("inchikey")), 1, 14).alias("block")
    k = table(s, d, "drug_assays").where("pubchem_cid > 0").select("drug_id", F.col("pubchem_cid").alias("cid"), block).distinct()
    x = table(s, d, "drug_xref")
    by_cid = x.where("pubchem_cid > 0").groupBy(F.col("pubchem_cid").alias("cid")).agg(F.min("xref_id").alias("xref_id"))
    by_block = x.where("inchikey IS NOT NULL").groupBy(block).agg(F.min("xref_id").alias("xref_id"))
    return R.first_match(k, [(by_cid, "cid"), (by_block, "block")], "xref_id", "xref_id").select("drug_id", "cid", "block", "xref_id")


query("r21_complete_cases", f"""WITH {P.SPARSE}, c AS (SELECT item FROM sparse GROUP BY 1 HAVING count(DISTINCT unit) >= floor(0.3 * (SELECT count(DISTINCT unit) FROM sparse))),
k AS (SELECT * FROM sparse WHERE item IN (SELECT item FROM c)), f AS (SELECT unit FROM k GROUP BY 1 HAVING count(DISTINCT item) = (SELECT count(*) FROM c)) SELECT unit, item, y_true FROM k WHERE unit IN (SELECT unit FROM f)""")(
    lambda s, d: R.complete_cases(P.sparse(s, d), "unit", "item", 0.3).select("unit", "item", "y_true")
)
query("r22_cross_few", """SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2""")(
    lambda s, d: dense_counts(s, d)
)


def dense_counts(s, d):
    """Every user against every event type: a pivot over the few types fills the cells, so no rows are crossed."""
    e = table(s, d, "events")
    kinds = vocabulary(e, "event_type")
    wide = e.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0)
    return wide.select("user_id", F.explode(F.array(*[F.struct(F.lit(k).alias("event_type"), F.col(f"`{k}`").alias("n")) for k in kinds])).alias("x")).select("user_id", "x.event_type", "x.n")


query("r24_sum_to_key", """SELECT l_suppkey AS sample, p_size AS key, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 5 GROUP BY 1, 2""")(
    lambda s, d: P.with_parts(s, d, "l_quantity").where("p_size > 5").groupBy(F.col("l_suppkey").alias("sample"), F.col("p_size").alias("key")).agg(F.sum("l_quantity").alias("value"))
)
query("r25_matched_cohort", f"""WITH s AS (SELECT DISTINCT sample_id, {PID.format("patient_id")} AS patient FROM samples WHERE patient_id IS NOT NULL)
SELECT DISTINCT patient_id FROM patients WHERE patient_id IN (SELECT patient FROM s JOIN baseline_expression USING (sample_id)) AND patient_id IN (SELECT patient FROM s JOIN drug_assays USING (sample_id))""")(lambda s, d: cohort(s, d))  # fmt: skip


def cohort(s, d):
    who = table(s, d, "samples").where("patient_id IS NOT NULL").select("sample_id", pid(F.col("patient_id")).alias("patient_id")).distinct()
    sides = [who.join(table(s, d, t), "sample_id", "left_semi") for t in ("baseline_expression", "drug_assays")]
    return R.matched_cohort(table(s, d, "patients").select("patient_id").distinct(), "patient_id", *sides)


query("r26_filtered_design", """SELECT DISTINCT patient_id, tissue_of_origin FROM patients WHERE subtype_granularity = 'fine' AND subtype IS NOT NULL AND lower(tissue_of_origin) IN ('bone', 'skin')""")(
    lambda s, d: table(s, d, "patients").where("subtype_granularity = 'fine' AND subtype IS NOT NULL AND lower(tissue_of_origin) IN ('bone', 'skin')").select("patient_id", "tissue_of_origin").distinct()
)
query("r27_thick_groups", "SELECT assay_id, drug_id FROM (SELECT assay_id, drug_id, count(*) OVER (PARTITION BY drug_id) AS n FROM drug_assays) WHERE n >= 20")(
    lambda s, d: R.thick_groups(table(s, d, "drug_assays").select("assay_id", "drug_id"), ["drug_id"], 20)
)
query("r29_controls", """SELECT drug_id, count(*) AS n FROM drug_assays WHERE lower(trim(drug_name, ' ')) IN ('dmso', 'pbs', 'vehicle', 'no drug', 'media only') GROUP BY 1""")(
    lambda s, d: table(s, d, "drug_assays").where(F.lower(F.trim("drug_name")).isin("dmso", "pbs", "vehicle", "no drug", "media only")).groupBy("drug_id").agg(F.count(F.lit(1)).alias("n"))
)
query("r30_one_hot", """SELECT patient_id, CAST(subtype_granularity = 'fine' AS INTEGER) AS fine, CAST(subtype_granularity = 'coarse' AS INTEGER) AS coarse, CAST(subtype_granularity IS NULL AS INTEGER) AS missing FROM (SELECT DISTINCT patient_id, subtype_granularity FROM patients)""")(
    lambda s, d: table(s, d, "patients").select("patient_id", "subtype_granularity").distinct().select("patient_id", *[(F.col("subtype_granularity") == v).cast("int").alias(v) for v in ("fine", "coarse")], F.col("subtype_granularity").isNull().cast("int").alias("missing"))
)
query("r31_unpivot", "SELECT xref_id, 'pubchem_cid' AS metric, CAST(pubchem_cid AS DOUBLE) AS value FROM drug_xref WHERE pubchem_cid IS NOT NULL UNION ALL SELECT xref_id, 'key_length', CAST(length(inchikey) AS DOUBLE) FROM drug_xref WHERE inchikey IS NOT NULL")(
    lambda s, d: R.unpivot_measures(table(s, d, "drug_xref").withColumn("key_length", F.length("inchikey")), ["xref_id"], ["pubchem_cid", "key_length"])
)
query("r32_facts_by_kind", """SELECT 'returned' AS kind, p_brand AS feature, l_suppkey AS unit FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' UNION SELECT 'bulk', p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49""")(
    lambda s, d: P.with_parts(s, d, "l_returnflag", "l_quantity").select(F.explode(F.array(F.when(F.col("l_returnflag") == "R", F.lit("returned")), F.when(F.col("l_quantity") >= 49, F.lit("bulk")))).alias("kind"), F.col("p_brand").alias("feature"), F.col("l_suppkey").alias("unit")).where("kind IS NOT NULL").distinct()
)
query("r33_threshold", f"WITH {P.DENSE} SELECT unit, item, CAST(y_true < 0.05 AS DOUBLE) AS y FROM dense")(lambda s, d: P.dense(s, d).select("unit", "item", (F.col("y_true") < 0.05).cast("double").alias("y")))

CORPUS = "u AS (SELECT s_suppkey AS unit FROM supplier WHERE s_acctbal < 0), i AS (SELECT p_partkey AS item FROM part WHERE p_size < 10)"


def corpus(s, d):
    return table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("unit")), table(s, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("item"))


query("r34_without_leakage", f"WITH {P.SPARSE}, {CORPUS} SELECT unit, item FROM sparse WHERE NOT (unit IN (SELECT unit FROM u) AND item IN (SELECT item FROM i))")(
    lambda s, d: R.without_leakage(P.sparse(s, d).select("unit", "item"), *corpus(s, d), direct=False)
)
query("r34_without_leakage_direct", f"WITH {P.SPARSE}, {CORPUS} SELECT unit, item FROM sparse WHERE NOT (unit IN (SELECT unit FROM u) OR item IN (SELECT item FROM i))")(
    lambda s, d: R.without_leakage(P.sparse(s, d).select("unit", "item"), *corpus(s, d), direct=True)
)
query("r34_leakage_profile", f"""WITH {P.SPARSE}, {CORPUS}, f AS (SELECT CAST(unit IN (SELECT unit FROM u) AS INTEGER) AS a, CAST(item IN (SELECT item FROM i) AS INTEGER) AS b FROM sparse)
SELECT count(*) AS n, round(avg(a), 6) AS unit_share, round(avg(b), 6) AS item_share, round(avg(a * b), 6) AS both_share FROM f""")(lambda s, d: R.leakage_profile(P.sparse(s, d).select("unit", "item"), *corpus(s, d)))  # fmt: skip

query("s12_capped_replicates", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k <= 3")(
    lambda s, d: R.head_per_group(table(s, d, "events"), ["user_id", "event_type"], ["event_id"], 3).select("user_id", "event_type", "event_id")
)
query("s7_narrow_then_wide", "SELECT doc_id, length(text) AS n FROM documents WHERE source = 'benchchat' AND n_chars > 1000")(lambda s, d: narrow_then_wide(s, d))


def narrow_then_wide(s, d):
    """Filters on the narrow columns reach the scan, which skips row groups before it reads the wide column."""
    return table(s, d, "documents").where("source = 'benchchat' AND n_chars > 1000").select("doc_id", F.length("text").alias("n"))


query("s9_pushed_filter", "SELECT drug_id, count(*) AS n FROM drug_assays WHERE drug_id IN (SELECT drug_id FROM predictions GROUP BY 1 HAVING count(*) > 100) GROUP BY 1")(
    lambda s, d: table(s, d, "drug_assays").join(table(s, d, "predictions").groupBy("drug_id").count().where("count > 100"), "drug_id", "left_semi").groupBy("drug_id").agg(F.count(F.lit(1)).alias("n"))
)
query("s10_gene_sets", """SELECT term_id, trim(x, ' ') AS member FROM (SELECT term_id, unnest(string_split(term_name || '; ' || coalesce(synonyms, ''), ';')) AS x FROM ref_terms) WHERE trim(x, ' ') <> ''""")(
    lambda s, d: table(s, d, "ref_terms").select("term_id", F.explode(F.split(F.concat_ws("; ", "term_name", F.coalesce("synonyms", F.lit(""))), ";")).alias("x")).select("term_id", F.trim("x").alias("member")).where("member <> ''")
)
query("w8_leave_one_out_mean", f"WITH {P.DENSE}, g AS (SELECT unit, item, y_true, sum(y_true) OVER (PARTITION BY item) AS t, count(*) OVER (PARTITION BY item) AS n FROM dense) SELECT unit, item, round((t - y_true) / (n - 1), 6) AS loo FROM g WHERE n > 1")(
    lambda s, d: loo(s, d)
)


def loo(s, d):
    return leave_one_out_mean(P.dense(s, d).select("unit", "item", "y_true"), ["item"], "y_true", "m").where("m IS NOT NULL").select("unit", "item", F.round("m", 6).alias("loo"))


query("w1_partition_median", f"WITH {P.DENSE} SELECT unit, item, round(y_true - m, 6) AS off FROM dense JOIN (SELECT unit, quantile_cont(y_true, 0.5) AS m FROM dense GROUP BY 1) USING (unit)")(
    lambda s, d: P.dense(s, d).select("unit", "item", F.round(F.col("y_true") - F.percentile("y_true", F.lit(0.5)).over(W.partitionBy("unit")), 6).alias("off"))
)
query("w4_row_number", f"WITH {P.DENSE} SELECT unit, item, row_number() OVER (PARTITION BY unit ORDER BY y_pred, item) AS k FROM dense")(lambda s, d: P.dense(s, d).select("unit", "item", F.row_number().over(W.partitionBy("unit").orderBy("y_pred", "item")).alias("k")))
query("w5_best_item", f"WITH {P.DENSE} SELECT unit, arg_min(item, (y_true, item)) AS item FROM dense GROUP BY 1")(lambda s, d: P.dense(s, d).groupBy("unit").agg(F.min_by("item", F.struct("y_true", "item")).alias("item")))
query("o2_global_top", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")(lambda s, d: table(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25))
query("o4_numeric_order", "SELECT prediction_id, k FROM (SELECT prediction_id, row_number() OVER (PARTITION BY drug_id ORDER BY CAST(substr(prediction_id, 3) AS BIGINT), created_at) AS k FROM predictions WHERE prediction_id IS NOT NULL) WHERE k = 1")(
    lambda s, d: R.keep_first(table(s, d, "predictions").where("prediction_id IS NOT NULL"), ["drug_id"], [F.substring("prediction_id", 3, 30).cast("bigint"), "created_at"]).select("prediction_id", F.lit(1).alias("k"))
)
query("a32_counts_with_unknown", "SELECT coalesce(subtype_granularity, 'unknown') AS g, count(*) AS n FROM patients GROUP BY 1")(lambda s, d: table(s, d, "patients").groupBy(F.coalesce("subtype_granularity", F.lit("unknown")).alias("g")).agg(F.count(F.lit(1)).alias("n")))
query("a33_cohort_counts", """SELECT p.tranche_id, count(DISTINCT p.patient_id) AS patients, any_value(coalesce(n, 0)) AS samples, list_sort(list(DISTINCT tissue_of_origin) FILTER (WHERE tissue_of_origin IS NOT NULL)) AS tissues
FROM patients p LEFT JOIN (SELECT tranche_id, count(DISTINCT sample_id) AS n FROM samples GROUP BY 1) s USING (tranche_id) GROUP BY 1""")(lambda s, d: cohort_counts(s, d))  # fmt: skip


def cohort_counts(s, d):
    n = table(s, d, "samples").groupBy("tranche_id").agg(F.countDistinct("sample_id").alias("n"))
    p = table(s, d, "patients").groupBy("tranche_id").agg(F.countDistinct("patient_id").alias("patients"), F.array_sort(F.collect_set("tissue_of_origin")).alias("tissues"))
    return p.join(n, "tranche_id", "left").select("tranche_id", "patients", F.coalesce("n", F.lit(0)).alias("samples"), "tissues")


