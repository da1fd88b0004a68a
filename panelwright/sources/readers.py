"""Files to tables: delimited text by suffix, feature sets, id lists and maps, matrices, manifests."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """A text table with a header; tabs for .tsv, .gz and .txt, commas otherwise.  Without a schema all is text."""
    bare = path.rstrip("*/")
    sep = "\t" if bare.endswith((".tsv", ".gz", ".txt")) else ","
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*columns) if columns else df


def feature_sets(spark: SparkSession, path: str, directions: dict[str, int]) -> DataFrame:
    """(signature, feature, direction) of the named sets in a file of tab-separated name, description, features..."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") > 2)
    named = F.create_map(*[F.lit(x) for kv in directions.items() for x in kv])
    rows = parts.select(F.col("p")[0].alias("signature"), F.explode(F.slice("p", 3, 1_000_000)).alias("feature"))
    rows = rows.where((F.trim("feature") != "") & F.col("signature").isin(list(directions)))
    return rows.select("signature", F.trim("feature").alias("feature"), named[F.col("signature")].alias("direction")).distinct()


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, target_id) of tab-separated lines; blank ids and short lines are left out."""
    p = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") > 1)
    return p.select(F.trim(F.col("p")[0]).alias("source_id"), F.trim(F.col("p")[1]).alias("target_id")).where("source_id <> '' AND target_id <> ''").distinct()


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("id")).where("id <> ''").distinct()


def matrix(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(sample, feature, value) from a wide file, by its suffix; missing cells stay out."""
    df = spark.read.parquet(path) if ".parquet" in path else delimited(spark, path)
    names = [c for c in df.columns if c != key]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").try_cast("double").alias("value")) for c in names]))
    return df.select(F.col(key).cast("string").alias("sample"), cells.alias("c")).select("sample", "c.feature", "c.value").where("value IS NOT NULL")


def embeddings(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, vector) of the rows of a two-dimensional .npy file, named by ``ids`` (position from 0, id).

    A file whose number of rows isn't that of the ids is refused.
    """

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                x = np.load(io.BytesIO(content), allow_pickle=False)
                for lo in range(0, len(x), 1024):
                    part = x[lo : lo + 1024].astype(np.float64)
                    yield pd.DataFrame({"position": range(lo, lo + len(part)), "vector": part.tolist()})

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "position long, vector array<double>")
    n, m = found.count(), ids.count()
    if n != m:
        raise ValueError(f"{n} rows but {m} ids")
    return found.join(ids.select(F.col("position").cast("long").alias("position"), "id"), "position").select("id", "vector")


def manifest_violations(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(file, problem) where the files under ``root`` and a manifest (file, sha256) disagree: missing, unrecorded or changed.

    ``file`` is the path below ``root``, so files of one name in different folders are different ones.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = re.escape(re.sub("^[a-z]+:/*", "/", root.rstrip("/")))
    found = files.select(F.regexp_replace("path", f"^.*?{bare}/", "").alias("file"), F.sha2("content", 256).alias("is"))
    both = found.join(manifest.select("file", F.col("sha256").alias("should")), "file", "full")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("should").isNull(), "unrecorded").when(F.col("is") != F.col("should"), "changed")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def violations(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """(rule, rows): how many rows break each named rule, a boolean column; null counts as broken."""
    counts = [F.sum(F.when(F.coalesce(r, F.lit(False)), 0).otherwise(1)).alias(n) for n, r in rules.items()]
    one = df.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("rows")) for n in rules])).alias("x")).select("x.rule", "x.rows")


LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(*names: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for n in names:
            LOADERS[n.lower()] = f
        return f

    return add


def load(name: str, *args: object, **options: object) -> DataFrame:
    """A dataset by its registered name or alias, in any letter case."""
    if name.lower() not in LOADERS:
        raise KeyError(f"no loader for {name!r}; there are {sorted(LOADERS)}")
    return LOADERS[name.lower()](*args, **options)


@loader("parquet")
def parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One table of any number of files or folders."""
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


loader("csv", "tsv", "delimited")(delimited)
loader("sets", "gmt")(feature_sets)
loader("matrix")(matrix)
loader("embeddings", "npy")(embeddings)

# fixed values: the collections that tranches belong to, and what else they are called
COHORTS = {"brevikpdo": ("brevik",), "corrincell": ("corrin",), "aldenscreen": ("alden",), "dunmorelab": ("dunmore",)}


@loader("cohort", "tranches")
def cohort(spark: SparkSession, folder: str, name: str, granularity: str | None = None) -> dict[str, DataFrame]:
    """patients, samples and drug_assays of the tranches of a collection, by its name or alias; ``granularity`` keeps patients whose subtype is known so."""
    found = next((c for c, others in COHORTS.items() if name.lower() in (c, *others)), None)
    if found is None:
        raise KeyError(f"no cohort {name!r}; there are {sorted(COHORTS)}")
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("patients", "samples", "drug_assays")}
    mine = F.col("tranche_id").startswith(f"cohort_{found}_")
    patients = t["patients"].where(mine) if granularity is None else t["patients"].where(mine & (F.col("subtype_granularity") == granularity))
    samples = t["samples"].where(mine)
    return {"patients": patients, "samples": samples, "drug_assays": t["drug_assays"].join(samples.select("sample_id").distinct(), "sample_id", "left_semi")}
