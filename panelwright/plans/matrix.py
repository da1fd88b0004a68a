"""Queries of matrices and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import matrix as X
from panelwright.plans import panels as P
from panelwright.plans.registry import query
from panelwright.session import table


def r6(df, *cols):
    return df.select(*[c for c in df.columns if c not in cols], *[F.round(c, 6).alias(c) for c in cols])


TOTAL = "t AS (SELECT *, sum(value) OVER (PARTITION BY sample) AS total FROM expr)"
query("n1_scaled", f"WITH {P.EXPR}, {TOTAL} SELECT sample, feature, round(value / CASE WHEN total = 0 THEN 1 ELSE total END * 1000000, 6) AS value FROM t")(lambda s, d: r6(X.scaled(P.expr(s, d), 1e6), "value"))
query("n2_log_scaled", f"WITH {P.EXPR}, {TOTAL} SELECT sample, feature, round(ln(1 + value / CASE WHEN total = 0 THEN 1 ELSE total END * 10000), 6) AS value FROM t")(lambda s, d: r6(X.scaled(P.expr(s, d), 1e4, log=True), "value"))
query("n3_panel_scaled", f"WITH {P.EXPR}, t AS (SELECT *, sum(value) OVER (PARTITION BY sample) AS total FROM expr WHERE feature LIKE 'Brand#1%') SELECT sample, feature, round(value / total * 1000000, 6) AS value FROM t")(
    lambda s, d: r6(X.panel_scaled(P.expr(s, d), P.expr(s, d).where("feature LIKE 'Brand#1%'"), 1e6), "value")
)
query("n4_size_factors", f"""WITH {P.EXPR}, g AS (SELECT feature, avg(ln(value)) AS c FROM expr WHERE value > 0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample) FROM expr))
SELECT sample, round(exp(quantile_cont(ln(value) - c, 0.5)), 6) AS factor FROM expr JOIN g USING (feature) GROUP BY 1""")(lambda s, d: r6(X.size_factors(P.expr(s, d)), "factor"))  # fmt: skip
Z = "z AS (SELECT sample, feature, (value - avg(value) OVER (PARTITION BY feature)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY feature) < 1e-12 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY feature) END AS value FROM expr)"
query("n5_z_scored", f"WITH {P.EXPR}, {Z} SELECT sample, feature, round(value, 6) AS value FROM z")(lambda s, d: r6(X.z_scored(P.expr(s, d)), "value"))
query("n6_floored_scaler", f"""WITH {P.EXPR}, f AS (SELECT feature, avg(value) AS m, greatest(stddev_pop(value), 20.0) AS sd FROM expr WHERE sample % 2 = 0 GROUP BY 1)
SELECT sample, feature, round((value - m) / sd, 6) AS value FROM expr JOIN f USING (feature) WHERE sample % 2 = 1""")(
    lambda s, d: r6(X.apply_scaler(P.expr(s, d).where("sample % 2 = 1"), X.scaler(P.expr(s, d).where("sample % 2 = 0"), 20.0)), "value")
)
query("n7_scatter_tokens", """WITH t AS (SELECT vec_id AS cell, unnest(range(64)) AS token, unnest(embedding) AS value FROM embeddings)
SELECT cell, 'g' || (token % 16) AS feature, round(sum(CAST(value AS DOUBLE)), 5) AS value FROM t WHERE token < 48 GROUP BY 1, 2""")(lambda s, d: tokens(s, d))  # fmt: skip


def tokens(s, d):
    t = table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), F.sequence(F.lit(0), F.lit(63)).alias("ids"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    names = s.range(48).select(F.col("id").cast("int").alias("token"), F.concat(F.lit("g"), F.col("id") % 16).alias("feature"))
    return X.scatter(t, names).select("cell", "feature", F.round("value", 5).alias("value"))


query("n8_reindexed", f"""WITH {P.EXPR} SELECT sample, [coalesce(sum(value) FILTER (WHERE feature = 'Brand#11'), 0), coalesce(sum(value) FILTER (WHERE feature = 'none'), 0), coalesce(sum(value) FILTER (WHERE feature = 'Brand#12'), 0)] AS vector
FROM expr WHERE feature IN ('Brand#11', 'Brand#12', 'none') GROUP BY 1""")(lambda s, d: X.reindexed(P.expr(s, d), ["Brand#11", "none", "Brand#12"]))  # fmt: skip
query("n9_unit_norm", """WITH s AS (SELECT vec_id, embedding, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS size FROM embeddings)
SELECT vec_id, unnest(range(len(embedding))) AS position, round(unnest([CAST(x AS DOUBLE) FOR x IN embedding]) / size, 6) AS value FROM s""")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(X.unit_norm(F.col("embedding"))).alias("position", "value")).withColumn("value", F.round("value", 6)).withColumn("position", F.col("position").cast("long"))
)
query("n10_bilinear", """WITH e AS (SELECT vec_id, unnest(range(64)) AS p, unnest([CAST(x AS DOUBLE) FOR x IN embedding]) AS v FROM embeddings), z AS (SELECT vec_id, p AS i, v FROM e WHERE p < 32), g AS (SELECT vec_id, p - 32 AS j, v FROM e WHERE p >= 32),
o AS (SELECT vec_id, i AS k, v FROM z UNION ALL SELECT vec_id, 32 + j, v FROM g UNION ALL SELECT vec_id, 64 + i * 32 + j, z.v * g.v FROM z JOIN g USING (vec_id))
SELECT vec_id, count(*) AS n, round(sum(v), 5) AS total, round(sum(v * v), 5) AS squares, round(sum(k * v), 3) AS placed FROM o GROUP BY 1""")(lambda s, d: bilinear(s, d))  # fmt: skip


def bilinear(s, d):
    """One half of every vector against the other: how many values, their sum, that of their squares, and the sum by place, which tells their order."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    f = e.select("vec_id", X.bilinear(F.slice("e", 1, 32), F.slice("e", 33, 32)).alias("f"))

    def added(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    placed = added(F.transform("f", lambda x, i: x * i))
    return f.select("vec_id", F.size("f").cast("long").alias("n"), F.round(added("f"), 5).alias("total"), F.round(added(F.transform("f", lambda x: x * x)), 5).alias("squares"), F.round(placed, 3).alias("placed"))


query("n11_random_projection", f"""WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest([CAST(x AS DOUBLE) FOR x IN embedding]) AS v FROM embeddings),
w AS (SELECT o, i, {P.normal_sql(5, "o", "i")} / sqrt(8.0) AS w FROM range(8) a(o), range(64) b(i)) SELECT vec_id, o AS position, round(sum(v * w), 5) AS value FROM e JOIN w USING (i) GROUP BY 1, 2""")(
    lambda s, d: X.projected(table(s, d, "embeddings"), "vec_id", "embedding", 64, 8, 5).select("vec_id", F.posexplode("projection").alias("position", "value")).select("vec_id", F.col("position").cast("long").alias("position"), F.round("value", 5).alias("value"))
)
query("a6_top_variance", f"WITH {P.EXPR} SELECT feature, round(var_samp(value), 4) AS variance FROM expr GROUP BY 1 ORDER BY var_samp(value) DESC, feature LIMIT 10")(
    lambda s, d: X.top_variance(P.expr(s, d), 10).select("feature", F.round("variance", 4).alias("variance"))
)
