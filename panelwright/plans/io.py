"""Queries of validation and of the streamed ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.plans.registry import query
from panelwright.session import table
from panelwright.sources.readers import violations
from panelwright.streaming.ingest import run_to_table, windowed_means


@query("t1_violations", """SELECT 'sample_id' AS rule, count(*) FILTER (WHERE sample_id IS NULL OR length(sample_id) < 1) AS rows FROM drug_assays UNION ALL
SELECT 'metric', count(*) FILTER (WHERE response_metric IS NULL OR response_metric NOT IN ('viability', 'ic50', 'auc', 'aac', 'dss', 'responder_binary')) FROM drug_assays UNION ALL
SELECT 'cid', count(*) FILTER (WHERE pubchem_cid IS NOT NULL AND pubchem_cid <= 0) FROM drug_assays UNION ALL
SELECT 'value', count(*) FILTER (WHERE response_value IS NULL OR CAST(response_value AS VARCHAR) = 'nan') FROM drug_assays""")  # fmt: skip
def t1(s, d):
    rules = {
        "sample_id": F.length("sample_id") >= 1,
        "metric": F.col("response_metric").isin("viability", "ic50", "auc", "aac", "dss", "responder_binary"),
        "cid": F.col("pubchem_cid").isNull() | (F.col("pubchem_cid") > 0),
        "value": F.col("response_value").isNotNull() & ~F.isnan("response_value"),
    }
    return violations(table(s, d, "drug_assays"), rules)


@query("st_event_windows", """SELECT epoch(date_trunc('day', ts))::BIGINT AS day_s, event_type, count(value) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2""")
def st(s, d):
    path = f"{d}/events.parquet"
    # a pattern, since a stream's plain path must be a folder
    stream = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_table(windowed_means(stream, "ts", "value", "event_type"), ["window_start", "event_type"])
    return out.select(F.unix_seconds("window_start").alias("day_s"), "event_type", "n", F.round(F.col("total") / F.col("n"), 5).alias("mean"))
