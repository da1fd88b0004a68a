"""Queries of the scalar functions, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.plans.registry import query
from panelwright.session import table

query("f1_subject_ids", r"""SELECT patient_id, nullif(upper(regexp_extract(patient_id, '(?i)(onx[0-9]+)', 1)), '') AS subject, count(*) AS n FROM samples GROUP BY 1, 2""")(
    lambda s, d: table(s, d, "samples").groupBy("patient_id", F.regexp_replace(T.subject_id(F.col("patient_id"), "onx"), "_.*$", "").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
)
query("f2_specimens", r"""WITH x AS (SELECT regexp_replace(lower(regexp_extract(patient_id, '(?i)onx[0-9]+(?:_[a-z0-9]+)*?_(tumou?r|organoids?)', 1)), 's$', '') AS w FROM samples)
SELECT CASE WHEN w = '' THEN NULL ELSE upper(w[1]) || w[2:] END AS specimen, count(*) AS n FROM x GROUP BY 1 HAVING specimen IS NOT NULL""")(
    lambda s, d: table(s, d, "samples").groupBy(T.specimen(F.col("patient_id"), "onx").alias("specimen")).agg(F.count(F.lit(1)).alias("n")).where("specimen IS NOT NULL")
)


@query("f3_label_and_number", r"""WITH x AS (SELECT DISTINCT p_brand || ' (' || p_size || ')' AS h FROM part)
SELECT h, regexp_extract(h, '^(.+?)\s*\(([0-9]+)\)\s*$', 1) AS label, CAST(regexp_extract(h, '^(.+?)\s*\(([0-9]+)\)\s*$', 2) AS BIGINT) AS number FROM x""")  # fmt: skip
def f3(s, d):
    h = table(s, d, "part").select(F.concat("p_brand", F.lit(" ("), "p_size", F.lit(")")).alias("h")).distinct()
    label, number = T.label_and_number(F.col("h"))
    return h.select("h", label.alias("label"), number.alias("number"))


@query("f4_unique_labels", """SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '__' || p_partkey ELSE p_name END AS label FROM part""")
def f4(s, d):
    from pyspark.sql import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy("p_name"))
    return table(s, d, "part").select("p_partkey", F.when(n > 1, F.concat_ws("__", "p_name", "p_partkey")).otherwise(F.col("p_name")).alias("label"))


query("f5_normal_names", "SELECT regexp_replace(lower(drug_name), '[^a-z0-9]', '', 'g') AS name, count(*) AS n FROM drug_assays GROUP BY 1")(
    lambda s, d: table(s, d, "drug_assays").groupBy(T.lower_alnum(F.col("drug_name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
)
query("f6_normal_cells", "SELECT regexp_replace(upper(metadata['block']), '[^A-Z0-9]', '', 'g') AS block, count(*) AS n FROM samples GROUP BY 1")(
    lambda s, d: table(s, d, "samples").groupBy(T.upper_alnum(F.col("metadata")["block"]).alias("block")).agg(F.count(F.lit(1)).alias("n"))
)
query("f7_numeric_ids", """SELECT xref_id, coalesce(CAST(CAST(TRY_CAST(CAST(pubchem_cid AS VARCHAR) || '.0' AS DOUBLE) AS BIGINT) AS VARCHAR), '') AS cid,
  coalesce(CAST(CAST(TRY_CAST(source_drug_id AS DOUBLE) AS BIGINT) AS VARCHAR), '') AS other FROM drug_xref""")(
    lambda s, d: table(s, d, "drug_xref").select("xref_id", T.digits_only_id(F.concat(F.col("pubchem_cid").cast("string"), F.lit(".0"))).alias("cid"), T.digits_only_id(F.col("source_drug_id")).alias("other"))
)
query("f8_doses", r"""WITH x AS (SELECT assay_id, '[(''' || drug_id || ''', ' || coalesce(CAST(round(response_value, 2) AS VARCHAR), 'x') || ', ''uM'')]' AS w FROM drug_assays WHERE response_metric = 'ic50')
SELECT DISTINCT assay_id, TRY_CAST(nullif(regexp_extract(w, ',\s*([0-9.eE+-]+)\s*,', 1), '') AS DOUBLE) AS dose FROM x""")(
    lambda s, d: table(s, d, "drug_assays").where("response_metric = 'ic50'").select("assay_id", T.dose(F.concat(F.lit("[('"), "drug_id", F.lit("', "), F.coalesce(F.round("response_value", 2).cast("string"), F.lit("x")), F.lit(", 'uM')]"))).alias("dose")).distinct()
)
query("f9_first_of_many", """SELECT term_id, TRY_CAST(TRY_CAST(trim(split_part(regexp_replace(coalesce(synonyms, 'none'), '[^0-9;]', '', 'g'), ';', 1)) AS DOUBLE) AS BIGINT) AS first FROM ref_terms""")(
    lambda s, d: table(s, d, "ref_terms").select("term_id", T.first_of_many(F.regexp_replace(F.regexp_replace(F.coalesce("synonyms", F.lit("none")), "[^0-9;]", ""), ";", ",")).alias("first"))
)
query("f10_nullable", """SELECT assay_id, CASE WHEN lower(trim(drugbank_id, ' ')) IN ('', 'nan', 'none', 'null', 'n/a', '-') THEN NULL ELSE trim(drugbank_id, ' ') END AS bank,
  CASE WHEN CAST(response_value AS VARCHAR) <> 'nan' THEN response_value END AS value FROM drug_assays""")(
    lambda s, d: table(s, d, "drug_assays").select("assay_id", T.text_or_null(F.col("drugbank_id")).alias("bank"), T.number_or_null(F.col("response_value")).alias("value"))
)
query("f13_key_blocks", r"""SELECT left(regexp_replace(upper(regexp_replace(inchikey, '\s+', '', 'g')), '^INCHIKEY=', ''), 14) AS block, count(*) AS n FROM drug_assays WHERE inchikey IS NOT NULL GROUP BY 1""")(
    lambda s, d: table(s, d, "drug_assays").where("inchikey IS NOT NULL").groupBy(T.key_block(F.col("inchikey")).alias("block")).agg(F.count(F.lit(1)).alias("n"))
)
query("f14_bits", "SELECT p_partkey, [CAST(x AS DOUBLE) FOR x IN string_split(lpad(bin(p_size), 6, '0'), '') IF x <> ''] AS bits FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", T.bits(F.lpad(F.bin("p_size"), 6, "0")).alias("bits"))
)
query("f15_scalars", """SELECT response_metric, round(sum(ln(1 + greatest(v, 0))), 4) AS logs, round(sum(greatest(v, 0)), 4) AS clipped, count(*) AS n FROM
(SELECT response_metric, CASE WHEN CAST(response_value AS VARCHAR) <> 'nan' THEN response_value ELSE 0 END AS v FROM drug_assays) GROUP BY 1""")(
    lambda s, d: table(s, d, "drug_assays").withColumn("v", F.coalesce(F.nanvl("response_value", F.lit(0.0)), F.lit(0.0))).groupBy("response_metric").agg(
        F.round(F.sum(F.log1p(F.greatest("v", F.lit(0.0)))), 4).alias("logs"), F.round(F.sum(F.greatest("v", F.lit(0.0))), 4).alias("clipped"), F.count(F.lit(1)).alias("n"))
)


@query("f12_metric_names", """WITH m(raw, metric) AS (VALUES ('ic50', 'IC50'), ('auc', 'AUC'), ('aac', 'AAC'), ('dss', 'DSS'))
SELECT coalesce(metric, 'skipped') AS metric, count(*) AS n FROM drug_assays LEFT JOIN m ON response_metric = raw GROUP BY 1""")  # fmt: skip
def f12(s, d):
    names = {"ic50": "IC50", "auc": "AUC", "aac": "AAC", "dss": "DSS"}
    renamed = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("response_metric")]
    return table(s, d, "drug_assays").groupBy(F.coalesce(renamed, F.lit("skipped")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))


query("f16_rounding", "SELECT l_suppkey, round_even(sum(l_quantity) / 8.0, 0) AS r FROM lineitem GROUP BY 1")(
    lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.bround(F.sum("l_quantity") / 8.0, 0).alias("r"))
)
query("m2_content_hash", "SELECT tranche_id, sha256(string_agg(patient_id, '' ORDER BY patient_id)) AS content_hash, count(*) AS n FROM (SELECT DISTINCT tranche_id, patient_id FROM patients) GROUP BY 1")(
    lambda s, d: table(s, d, "patients").select("tranche_id", "patient_id").distinct().groupBy("tranche_id").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("patient_id"))), 256).alias("content_hash"), F.count(F.lit(1)).alias("n"))
)
query("m3_row_fingerprint", """SELECT source, count(*) AS n, bit_xor(CAST(('0x' || left(md5(xref_id || '|' || input_name), 8)) AS BIGINT)) AS fingerprint FROM (SELECT DISTINCT source, xref_id, input_name FROM drug_xref) GROUP BY 1""")(
    lambda s, d: table(s, d, "drug_xref").select("source", "xref_id", "input_name").distinct().groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring(F.md5(F.concat_ws("|", "xref_id", "input_name")), 1, 8), 16, 10).cast("bigint")).alias("fingerprint"))
)
