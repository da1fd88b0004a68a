"""Panels bound to the given tables, each with the SQL that makes the same relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import table


def with_parts(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", *cols).join(part, F.col("l_partkey") == F.col("p_partkey"))


def panel(df: DataFrame, unit: str, item: str) -> DataFrame:
    return df.groupBy(F.col(unit).alias("unit"), F.col(item).alias("item")).agg(F.round(F.avg("l_discount"), 9).alias("y_true"), F.round(F.avg("l_tax"), 9).alias("y_pred"))


def dense(spark: SparkSession, d: str) -> DataFrame:
    return panel(with_parts(spark, d, "l_discount", "l_tax"), "l_suppkey", "p_brand")


def sparse(spark: SparkSession, d: str) -> DataFrame:
    return panel(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


def types(spark: SparkSession, d: str) -> DataFrame:
    """The class of each item of the sparse panel."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("class"))


def expr(spark: SparkSession, d: str) -> DataFrame:
    return with_parts(spark, d, "l_quantity").groupBy(F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One row a line item: a cell of a line under a treatment, with one feature's value."""
    return with_parts(spark, d, "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell"),
        F.col("l_suppkey").alias("line"),
        F.concat("l_returnflag", "l_linestatus").alias("drug"),
        ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("is_control"),
        F.col("p_brand").alias("feature"),
        F.col("l_quantity").alias("value"),
        F.col("l_orderkey").alias("plate"),
    )


def sql_round(c: str, places: int) -> Column:
    """Rounded as the SQL does it, which multiplies first: 0.0646875 is 64687.49999999999 millionths and goes down."""
    return (F.round(F.col(c) * 10.0**places) / 10.0**places).alias(c)


def probs(spark: SparkSession, d: str) -> DataFrame:
    """A binary truth and a probability for each usable prediction."""
    p = table(spark, d, "predictions")
    fine = F.col("predicted_value").between(0, 1) & ~F.isnan("predicted_value") & F.col("predicted_responder").isNotNull()
    return p.where(fine).groupBy("prediction_id").agg(F.max(F.col("predicted_responder").cast("double")).alias("y_true"), F.max("predicted_value").alias("y_pred"))


DENSE = """dense AS (
  SELECT l_suppkey AS unit, p_brand AS item, round(avg(l_discount), 9) AS y_true, round(avg(l_tax), 9) AS y_pred
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

SPARSE = """sparse AS (
  SELECT l_suppkey AS unit, l_partkey AS item, round(avg(l_discount), 9) AS y_true, round(avg(l_tax), 9) AS y_pred
  FROM lineitem GROUP BY 1, 2)"""

EXPR = """expr AS (
  SELECT l_suppkey AS sample, p_brand AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

CELLS = """cells AS (
  SELECT l_orderkey || '-' || l_linenumber AS cell, l_suppkey AS line, l_returnflag || l_linestatus AS drug, (l_returnflag = 'N' AND l_linestatus = 'O') AS is_control,
    p_brand AS feature, l_quantity AS value, l_orderkey AS plate FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PROBS = """probs AS (
  SELECT prediction_id, max(CAST(predicted_responder AS DOUBLE)) AS y_true, max(predicted_value) AS y_pred FROM predictions
  WHERE predicted_value BETWEEN 0 AND 1 AND CAST(predicted_value AS VARCHAR) <> 'nan' AND predicted_responder IS NOT NULL GROUP BY 1)"""


def ranks_sql(source: str, keys: str, t: str = "y_true", q: str = "y_pred", least: int = 3) -> str:
    """CTEs g and r: average ranks of t and q, centred, within ``keys`` of at least ``least`` rows."""
    return f"""g AS (SELECT *, round({t}, 9) AS t9, round({q}, 9) AS q9, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY t9) + (count(*) OVER (PARTITION BY {keys}, t9) - 1) / 2.0 - (n + 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY {keys} ORDER BY q9) + (count(*) OVER (PARTITION BY {keys}, q9) - 1) / 2.0 - (n + 1) / 2.0 AS rq FROM g WHERE n >= {least})"""


RHO = "round(CASE WHEN stddev_pop(rt) < 1e-12 OR stddev_pop(rq) < 1e-12 THEN 0.0 ELSE corr(rt, rq) END, 6)"


def uniform_sql(seed, *cols):
    return f"((CAST('0x' || left(md5('{seed}:' || {" || ':' || ".join(cols)}), 12) AS BIGINT) + 0.5) / {1 << 48}.0)"


def normal_sql(seed, *cols):
    return f"(sqrt(-2 * ln({uniform_sql(seed, *cols)})) * cos(2 * pi() * {uniform_sql(seed + 1, *cols)}))"
