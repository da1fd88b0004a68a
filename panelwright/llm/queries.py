"""The queries of the numbered problems, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import p1_linkage, p2_canonical, p3_splits, p4_knn, p5_topn, p6_overlap, p7_packing, p8_leaks, p9_truncation
from panelwright.session import checkpointed, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "ref_terms").where("field_name = 'drug_name'")
    return p1_linkage.linked(table(spark, d, "drug_assays"), table(spark, d, "drug_xref"), terms)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_links(spark, d).where("confidence >= 0.5").select("drug_id", "xref_id")


def typed(spark: SparkSession, d: str) -> DataFrame:
    subtypes = table(spark, d, "patients").select(F.lit("subtype").alias("field"), F.col("patient_id").alias("record_id"), F.col("subtype").alias("value"))
    drugs = table(spark, d, "drug_assays").select(F.lit("drug_name").alias("field"), F.col("assay_id").alias("record_id"), F.col("drug_name").alias("value"))
    return subtypes.unionByName(drugs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_canonical.mapped_records(typed(spark, d), table(spark, d, "ref_terms"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return p2_canonical.unmatched_values(typed(spark, d), table(spark, d, "ref_terms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_splits.patient_groups(table(spark, d, "patients"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    patients = table(spark, d, "patients").where("patient_id IS NOT NULL").groupBy("patient_id").agg(F.min("subtype").alias("value"))
    terms = table(spark, d, "ref_terms").where("field_name = 'subtype'")
    known = p2_canonical.mapped_values(patients.select(F.lit("subtype").alias("field"), "value"), terms).select("value", "term_id")
    exact = terms.select(F.col("term_name").alias("value"), "term_id")
    label = checkpointed(known.unionByName(exact).groupBy("value").agg(F.min("term_id").alias("label")))
    groups = checkpointed(p3_splits.patient_groups(table(spark, d, "patients")))
    records = patients.join(label, "value", "left").join(groups, "patient_id", "left")
    first = groups.select(F.col("group_first").alias("patient_id"), F.lit(True).alias("leads")).distinct()
    records = records.join(first, "patient_id", "left").select(F.col("patient_id").alias("record"), F.coalesce("group_first", F.when(F.col("leads"), F.col("patient_id"))).alias("group"), "label")
    split = p3_splits.grouped_stratified_split(records, table(spark, d, "split_plan"))
    return split.select(F.col("record").alias("patient_id"), F.col("group").alias("group_key"), F.col("label").alias("subtype_term"), F.col("split").alias("split_label"))


def p3_split_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every split of the plan: whether it has its share of the patients, to 2 %, its share of every term of 50 or more, to 10 %, and how many groups it shares with another."""
    split, plan = checkpointed(p3_split(spark, d)), table(spark, d, "split_plan").select("split_label", "target_share").distinct()
    size = split.agg(F.count("*").alias("all"))
    whole = split.groupBy("split_label").agg(F.count("*").alias("n"))
    terms = split.groupBy("subtype_term").agg(F.count("*").alias("of")).where("of >= 50").crossJoin(F.broadcast(plan))  # three splits
    held = split.groupBy("subtype_term", "split_label").agg(F.count("*").alias("k"))
    off = terms.join(held.withColumnRenamed("subtype_term", "term"), (F.col("term").eqNullSafe(F.col("subtype_term"))) & (held["split_label"] == plan["split_label"]), "left")
    off = off.groupBy(plan["split_label"]).agg(F.max(F.abs(F.coalesce("k", F.lit(0)) / F.col("of") - F.col("target_share"))).alias("off"))
    torn = split.select("group_key", "split_label").distinct().groupBy("group_key").agg(F.collect_list("split_label").alias("in")).where(F.size("in") > 1)
    torn = torn.select(F.explode("in").alias("split_label")).groupBy("split_label").agg(F.count("*").alias("divided"))
    out = plan.join(whole, "split_label", "left").join(off, "split_label", "left").join(torn, "split_label", "left").crossJoin(F.broadcast(size))
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("all") - F.col("target_share")) <= 0.02
    return out.select("split_label", near.alias("has_share"), (F.coalesce("off", F.lit(0.0)) <= 0.1).alias("has_terms"), F.coalesce("divided", F.lit(0)).alias("divided_groups"))


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "baseline_expression").select("sample_id", "expression_matrix_uri").distinct()
    profiles = table(spark, d, "expression_profiles").select("expression_matrix_uri", "profile")
    return p4_knn.most_similar(base.join(profiles, "expression_matrix_uri"), "sample_id", "profile", 64)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_similar(spark, d).select(F.least("sample_id", "other").alias("sample_a"), F.greatest("sample_id", "other").alias("sample_b")).distinct()


def p5_top_items(spark: SparkSession, d: str) -> DataFrame:
    return p5_topn.top_n(table(spark, d, "predictions"), "sample_id", "drug_id", "predicted_value", 5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_top_items(spark, d).select("sample_id", "drug_id")


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return p6_overlap.overlaps(table(spark, d, "split_folds"), table(spark, d, "patients"), table(spark, d, "samples"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_overlaps(spark, d).select("fold_id", "patient_a", "patient_b")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return p6_overlap.overlap_counts(p6_overlaps(spark, d), table(spark, d, "split_folds"), table(spark, d, "patients"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    counts = p7_packing.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return p7_packing.packed(counts, table(spark, d, "pack_targets")).withColumnRenamed("doc", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing.fill_report(p7_containers(spark, d), table(spark, d, "pack_targets"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every kind of container: those over capacity, documents not packed whole, documents divided though they fit, and whether it takes at most 1 % and three containers more than the tokens fill."""
    counts = checkpointed(p7_packing.token_counts(table(spark, d, "documents"), "doc_id", "text").where("tokens > 0").distinct())
    targets = table(spark, d, "pack_targets").select("target_id", F.col("capacity_tokens").alias("capacity")).distinct()
    packed = checkpointed(p7_packing.packed(counts, table(spark, d, "pack_targets")))
    each = packed.groupBy("target_id", "container_id").agg(F.sum("tokens").alias("t")).join(F.broadcast(targets), "target_id")  # a row for each kind
    bins = each.groupBy("target_id").agg(F.sum((F.col("t") > F.col("capacity")).cast("long")).alias("over_capacity"), F.count("*").alias("bins"), F.sum("t").alias("tokens"), F.max("capacity").alias("c"))
    whole = packed.groupBy("target_id", "doc").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"), F.min("first_token").alias("lo")).join(F.broadcast(targets), "target_id").join(counts, "doc", "left")
    docs = whole.groupBy("target_id").agg(F.sum(F.when((F.col("t") == F.col("tokens")) & (F.col("lo") == 0), 0).otherwise(1)).alias("not_whole"), F.sum(((F.col("k") > 1) & (F.col("tokens") <= F.col("capacity"))).cast("long")).alias("divided"), F.count("*").alias("docs"))
    size = counts.agg(F.count("*").alias("all"))
    out = bins.join(docs, "target_id").crossJoin(F.broadcast(size))
    return out.select("target_id", "over_capacity", (F.col("not_whole") + F.col("all") - F.col("docs")).alias("not_whole"), "divided", (F.col("bins") <= F.ceil(F.col("tokens") / F.col("c")) * 1.01 + 3).alias("tight"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "benchmark").distinct()
    return p8_passages(spark, d).groupBy("item_id").agg(F.count("*").alias("docs"), F.max("words").alias("words")).join(items, "item_id")


def p9_cut(spark: SparkSession, d: str) -> DataFrame:
    return p9_truncation.truncated(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_cut(spark, d).select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return p9_truncation.truncation_rates(table(spark, d, "documents"), p9_cut(spark, d))


QUERIES: list[Query] = [
    p1_found, p1_links, p2_found, p2_unmatched, p3_found, p3_split, p3_split_check, p4_found, p4_similar, p5_found, p5_top_items,
    p6_found, p6_overlaps, p6_report, p7_containers, p7_report, p7_check, p8_found, p8_passages, p8_items, p9_found, p9_cut, p9_rates,
]

TOP = """WITH b AS (
  SELECT sample_id, drug_id, max(predicted_value) AS predicted_value FROM predictions
  WHERE sample_id IS NOT NULL AND drug_id IS NOT NULL AND CAST(predicted_value AS VARCHAR) NOT IN ('nan', 'inf', '-inf')
  GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY predicted_value DESC, drug_id) AS INTEGER) AS rank FROM b)
"""

GROUPS = r"""WITH RECURSIVE p AS (
  SELECT DISTINCT patient_id,
    regexp_replace(regexp_replace(upper(regexp_replace(patient_id, '\s+', '', 'g')), '_(TUMOU?RS?|ORGANOIDS?)$', ''), '^([A-Z]+)[-_]+([0-9])', '\1\2') AS canon,
    regexp_replace(regexp_replace(upper(regexp_replace(metadata['related_to'], '\s+', '', 'g')), '_(TUMOU?RS?|ORGANOIDS?)$', ''), '^([A-Z]+)[-_]+([0-9])', '\1\2') AS named,
    CASE WHEN ltrim(regexp_extract(regexp_replace(upper(metadata['donor']), '[^A-Z0-9]', '', 'g'), '([0-9]+)$', 1), '0') <> ''
      THEN regexp_extract(regexp_replace(upper(metadata['donor']), '[^A-Z0-9]', '', 'g'), '^([A-Z]*)', 1) || '-' || ltrim(regexp_extract(regexp_replace(upper(metadata['donor']), '[^A-Z0-9]', '', 'g'), '([0-9]+)$', 1), '0') END AS donor
  FROM patients WHERE patient_id IS NOT NULL),
e AS (
  SELECT a.patient_id AS a, b.patient_id AS b FROM p a JOIN p b ON a.donor = b.donor OR a.named = b.canon OR b.named = a.canon OR a.canon = b.canon),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS patient_id, min(b) AS group_first FROM r GROUP BY 1)
SELECT DISTINCT group_first, patient_id FROM g WHERE group_first <> patient_id"""

SIMILAR = """WITH v AS (
  SELECT DISTINCT sample_id, CAST(profile AS DOUBLE[]) AS x FROM baseline_expression JOIN expression_profiles USING (expression_matrix_uri)
  WHERE sample_id IS NOT NULL AND len(profile) = 64 AND len(list_filter(profile, lambda y: y IS NOT NULL AND NOT isnan(y) AND NOT isinf(y))) = 64
    AND len(list_filter(profile, lambda y: y <> 0)) > 0),
s AS (SELECT a.sample_id AS a, b.sample_id AS b, round(list_cosine_similarity(a.x, b.x), 6) AS c FROM v a JOIN v b ON a.sample_id <> b.sample_id),
k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM s WHERE c >= 0.8)
SELECT DISTINCT least(a, b) AS sample_a, greatest(a, b) AS sample_b FROM k WHERE n <= 5"""


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": GROUPS,
        "p3_split_check": "SELECT DISTINCT split_label, true AS has_share, true AS has_terms, CAST(0 AS BIGINT) AS divided_groups FROM split_plan",
        "p4_found": SIMILAR,
        "p5_found": TOP + "SELECT sample_id, drug_id FROM r WHERE rank <= 5",
        "p7_check": "SELECT DISTINCT target_id, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS divided, true AS tight FROM pack_targets WHERE capacity_tokens > 0",
        "p5_top_items": TOP + "SELECT sample_id, drug_id, predicted_value, rank FROM r WHERE rank <= 5",
    }
