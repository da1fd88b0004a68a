"""Problem 3: splits that keep related records together and each split's mix of labels near that of all.

Components of the relations come from alternating stars.  The assignment is grouped iterative
stratification: of the labels still outstanding the rarest goes first, its components by size, each into
the split that lacks most of that label.  Components beyond a share of all rows (so few that their number
has a bound) are placed first; the others fall by hash into blocks of bounded size, and each block places
its own against its part of what is still wanted, all blocks at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.components import components
from panelwright.llm.ids import canonical_donor, canonical_patient
from panelwright.session import checkpointed

GIANT_SHARE = 0.001  # a component above this share of all rows is placed on its own: at most 1000 of them
BLOCK_GROUPS = 20_000  # components in a block, about
MAX_SPLITS = 1_000  # a plan with more is refused
MAX_LABELS = 5_000  # labels come from a vocabulary; a table with more is refused


def patient_links(patients: DataFrame) -> DataFrame:
    """(a, b) of patient ids tied by one donor code or by one's related_to naming the other.

    Placeholders for an unknown donor, and names of patients that the table doesn't hold, tie nobody.
    """
    p = patients.where(F.col("patient_id").isNotNull()).select(
        "patient_id",
        canonical_patient(F.col("patient_id")).alias("canon"),
        canonical_donor(F.col("metadata")["donor"]).alias("donor"),
        canonical_patient(F.col("metadata")["related_to"]).alias("named"),
    )
    hub = p.where("donor IS NOT NULL").groupBy("donor").agg(F.min("patient_id").alias("b"))
    by_donor = p.where("donor IS NOT NULL").join(hub, "donor").select(F.col("patient_id").alias("a"), "b")
    known = p.groupBy("canon").agg(F.min("patient_id").alias("b"))
    by_name = p.where("named IS NOT NULL").select(F.col("patient_id").alias("a"), F.col("named").alias("canon")).join(known, "canon").select("a", "b")
    spelt = p.select(F.col("patient_id").alias("a"), "canon").distinct().join(known, "canon").select("a", "b")
    return by_donor.union(by_name).union(spelt).where("a <> b").distinct()


def patient_groups(patients: DataFrame) -> DataFrame:
    """(group_first, patient_id): the groups that may not be divided, a row for each other member."""
    return components(patient_links(patients)).select(F.col("root").alias("group_first"), F.col("node").alias("patient_id"))


def place(groups: list[tuple[str, dict[int, float], float]], wanted: np.ndarray) -> list[int]:
    """A split for each (name, rows by label, rows), by iterative stratification; ``wanted`` (split, label) is used up."""
    split_of: list[int] = [-1] * len(groups)
    holders: dict[int, list[int]] = {}
    left: dict[int, float] = {}
    for i, (_, counts, _) in enumerate(groups):
        for label, n in counts.items():
            holders.setdefault(label, []).append(i)
            left[label] = left.get(label, 0) + n
    size = wanted.sum(axis=1)
    while left:
        label = min(left, key=lambda x: (left[x], x))
        for i in sorted((i for i in holders[label] if split_of[i] < 0), key=lambda i: (-groups[i][2], groups[i][0])):
            _, counts, rows = groups[i]
            s = max(range(len(wanted)), key=lambda s: (round(wanted[s, label], 9), round(size[s], 9), -s))
            split_of[i] = s
            size[s] -= rows
            for other, n in counts.items():
                wanted[s, other] -= n
                if other in left:
                    left[other] -= n
        del left[label]
    return split_of


def grouped_stratified_split(records: DataFrame, plan: DataFrame) -> DataFrame:
    """(record, group, label, split) for ``records`` (record, group, label) and ``plan`` (split_label, target_share).

    All records of a group land in one split.  A null group makes the record a group of its own; a null label
    is a label like any other; repeated rows count once, null records don't count.  Shares are scaled to sum
    to 1; null or non-positive shares don't count.  No record or no share gives no row.
    """
    spark = records.sparkSession
    shares = [(r[0], float(r[1])) for r in plan.where("split_label IS NOT NULL AND target_share > 0").select("split_label", "target_share").distinct().orderBy(F.desc("target_share"), "split_label").limit(MAX_SPLITS + 1).collect()]
    if len(shares) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    own = records.where("record IS NOT NULL").select("record", F.coalesce(F.col("group").cast("string"), F.concat(F.lit("record "), F.col("record").cast("string"))).alias("group"), "label")
    own = checkpointed(own.dropDuplicates(["record"]))
    schema = T.StructType([*own.schema.fields, T.StructField("split", T.StringType())])
    labels = own.groupBy("label").count().limit(MAX_LABELS + 1).collect()
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not labels or not shares:
        return spark.createDataFrame([], schema)
    share = np.array([x for _, x in shares]) / sum(x for _, x in shares)
    # labels too rare to be had in every split are stratified as one
    rare = {r["label"] for r in labels if r["count"] * share.min() < 1}
    common = sorted((r["label"] for r in labels if r["label"] not in rare), key=lambda x: (x is None, x))
    code = {label: i for i, label in enumerate(common)} | dict.fromkeys(rare, len(common))
    total = np.zeros(len(common) + 1)
    for r in labels:
        total[code[r["label"]]] += r["count"]
    codes = spark.createDataFrame(list(code.items()), T.StructType([T.StructField("of", own.schema["label"].dataType), T.StructField("code", T.IntegerType())]))  # at most MAX_LABELS rows
    coded = own.join(F.broadcast(codes), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    vectors = (
        coded.groupBy("group", "code").agg(F.count("*").alias("n")).groupBy("group").agg(F.collect_list(F.struct("code", "n")).alias("counts"), F.sum("n").alias("size"))
    )
    vectors = checkpointed(vectors)
    rows = total.sum()
    giants = vectors.where(F.col("size") > GIANT_SHARE * rows).orderBy(F.desc("size"), "group").collect()  # at most 1 / GIANT_SHARE
    wanted = share[:, None] * total[None, :]
    listed = [(r["group"], {c["code"]: c["n"] for c in r["counts"]}, r["size"]) for r in giants]
    placed = place(listed, wanted)
    rest = total.copy()
    for _, counts, _ in listed:
        for label, n in counts.items():
            rest[label] -= n
    names = [x for x, _ in shares]
    first = spark.createDataFrame([(g[0], names[s]) for g, s in zip(listed, placed, strict=True)], "group string, split string")
    others = vectors.where(F.col("size") <= GIANT_SHARE * rows)
    blocks = max(1, math.ceil(others.count() / BLOCK_GROUPS))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [(g, {c["code"]: c["n"] for c in counts}, size) for g, counts, size in zip(pdf["group"], pdf["counts"], pdf["size"], strict=True)]
        part = np.zeros(len(rest))
        for _, counts, _ in groups:
            for label, n in counts.items():
                part[label] += n
        own_share = wanted * np.where(rest > 0, part / np.maximum(rest, 1), 0)[None, :]
        return pd.DataFrame({"group": pdf["group"], "split": [names[s] for s in place(groups, own_share)]})

    second = others.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks))).groupBy("block").applyInPandas(block, "group string, split string")
    return own.join(first.unionByName(second), "group").select("record", "group", "label", "split")
