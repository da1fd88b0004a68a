"""Problem 1: the same things in sources without a common key, by a label model over heuristic votes.

Pairs become candidates by sharing an identifier, a code, or a name up to two slips (two names within two
slips share a form with at most two letters left out, or, if they are long, one of five pieces, so none is missed and
no common word is a key).
Matching functions vote on every candidate: 1 for, -1 against, 0 for no opinion.  A generative model
learns from the votes alone how often each function errs and which functions err together (a forest of
dependences between functions within each class), and gives every pair its posterior confidence.
The model sees only how many pairs voted in which way: at most three to the number of functions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm import names
from panelwright.session import checkpointed

VOTES = ("cid", "key", "bank", "code", "alias", "name")
LONG = 24  # letters of a name beyond which it is looked up by pieces
SAID = "value string, kind string, name string, spoken string, codes array<string>"


def said(values: DataFrame) -> DataFrame:
    """What each distinct ``value`` says as the name of a substance."""

    def read(batches):
        for pdf in batches:
            rows = []
            for v in pdf["value"]:
                s = names.substance(v)
                rows.append((v, s["kind"], s["name"], names.spoken(s["name"]), s["codes"]))
            yield pd.DataFrame(rows, columns=["value", "kind", "name", "spoken", "codes"])

    return values.where("value IS NOT NULL").distinct().mapInPandas(read, SAID)


def left_out(name: str, most: int = 2) -> set[str]:
    """The name, and every form with up to ``most`` letters left out."""
    return {name} | {"".join(c for i, c in enumerate(name) if i not in gone) for k in range(1, most + 1) for gone in combinations(range(len(name)), k)}


def name_forms(name: str, asks: bool) -> set[str]:
    """Keys of a name, such that an asking and a given one within two slips share one; their number grows with the name's length at most.

    Up to LONG letters they are the forms with letters left out.  Of a longer name, five pieces: two slips, even where
    two letters changed places across a border, touch four of them.  The asking side tries every length within two
    slips, and every place that a piece may have moved to.
    """
    n = len(name)
    out = left_out(name) if n <= LONG + (2 if asks else 0) else set()
    for length in range(n - 2, n + 3) if asks else (n,):
        if length > LONG:
            for j in range(5):
                lo, hi = j * length // 5, (j + 1) * length // 5
                out |= {f"{length} {j} {name[lo + off : hi + off]}" for off in (range(-2, 3) if asks else (0,)) if 0 <= lo + off and hi + off <= n}
    return out


def identifiers(cid: str, inchikey: str, bank: str) -> list[Column]:
    """One form for each identifier, null where it says nothing: (cid, key, bank)."""
    key = F.regexp_replace(F.upper(F.regexp_replace(inchikey, r"[\s ]+", "")), "^INCHIKEY=", "")
    code = F.regexp_replace(F.upper(bank), "[^A-Z0-9]", "")
    return [
        F.when(F.col(cid) > 0, F.col(cid).cast("string")).alias("cid"),
        F.when(F.length(key) >= 14, F.substring(key, 1, 14)).alias("key"),
        F.when(F.length(code) >= 4, code).alias("bank"),
    ]


def commonest(df: DataFrame, group: str, value: str, weight: str, most: int = 1) -> DataFrame:
    """(group, values): the ``most`` values of the greatest total weight, nulls and empty values apart."""
    total = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(group, value).agg(F.sum(weight).alias("n"))
    first = total.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("r") <= most)
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def left_profiles(assays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every drug_id that isn't a control or a mixture: its commonest names, codes and identifiers; and its aliases.

    An identifier that is wrong in single rows loses to the one that most rows give.
    """
    rows = assays.where("drug_id IS NOT NULL").select("drug_id", "assay_id", F.col("drug_name").alias("value"), *identifiers("pubchem_cid", "inchikey", "drugbank_id")).distinct()
    counted = checkpointed(rows.groupBy("drug_id", "value", "cid", "key", "bank").agg(F.count("*").alias("n")))
    typed = counted.where("value IS NOT NULL").groupBy("drug_id", "value").agg(F.sum("n").alias("n")).join(said(counted.select("value")), "value")
    typed = checkpointed(typed)
    kinds = typed.groupBy("drug_id").agg(F.sum(F.when(F.col("kind").isin("mixture", "nothing"), F.col("n")).otherwise(0)).alias("not"), F.sum("n").alias("all"))
    out = counted.select("drug_id").distinct().join(kinds.where("`not` * 2 > `all`"), "drug_id", "left_anti")
    codes = typed.select("drug_id", "n", F.explode("codes").alias("code"))
    spoken = commonest(typed, "drug_id", "spoken", "n", 1)
    for name, part in (
        ("name", commonest(typed, "drug_id", "name", "n", 3)),
        ("spoken", spoken),
        ("codes", commonest(codes, "drug_id", "code", "n", 3)),
        ("cid", commonest(counted, "drug_id", "cid", "n")),
        ("key", commonest(counted, "drug_id", "key", "n")),
        ("bank", commonest(counted, "drug_id", "bank", "n")),
    ):
        out = out.join(part.withColumnRenamed("values", name), "drug_id", "left")
    together = codes.join(spoken.select("drug_id", F.col("values")[0].alias("spoken")), "drug_id").select("code", "spoken", "n")
    return out.select(F.col("drug_id").alias("id"), "name", F.col("spoken")[0].alias("spoken"), "codes", *[F.col(c)[0].alias(c) for c in ("cid", "key", "bank")]), together


def right_profiles(xref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every xref_id its name, codes (those of the note 'syn.' too) and identifiers; and its aliases."""
    rows = xref.where("xref_id IS NOT NULL").select("xref_id", F.col("input_name").alias("value"), F.regexp_extract("notes", r"(?i)^\s*syn\.?:?\s*(.+)$", 1).alias("note"), *identifiers("pubchem_cid", "inchikey", "drugbank_id")).distinct()
    rows = checkpointed(rows)
    words = checkpointed(said(rows.select("value").union(rows.select("note"))))
    note = words.select(F.col("value").alias("note"), F.col("spoken").alias("note_spoken"), F.col("codes").alias("note_codes"))
    full = rows.join(words, "value", "left").join(note, "note", "left")
    full = full.withColumn("codes", F.array_union(F.coalesce("codes", F.array().cast("array<string>")), F.coalesce("note_codes", F.array().cast("array<string>"))))
    full = full.withColumn("spoken", F.coalesce(F.nullif("spoken", F.lit("")), F.nullif("note_spoken", F.lit(""))))
    full = full.where(F.coalesce("kind", F.lit("code")).isin("name", "code") | F.coalesce("cid", "key", "bank").isNotNull())
    one = full.groupBy(F.col("xref_id").alias("id")).agg(
        F.collect_set(F.nullif("name", F.lit(""))).alias("name"), F.min("spoken").alias("spoken"), F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"),
        F.min("cid").alias("cid"), F.min("key").alias("key"), F.min("bank").alias("bank"),
    )
    together = full.select(F.explode("codes").alias("code"), "spoken", F.lit(1).alias("n")).where("spoken IS NOT NULL")
    return one, together


def with_alias(profiles: DataFrame, alias: DataFrame) -> DataFrame:
    """Adds the codes that others give for the entity's name."""
    extra = profiles.where("spoken IS NOT NULL").select("id", "spoken").join(alias, "spoken").groupBy("id").agg(F.collect_set("code").alias("others"))
    none = F.array().cast("array<string>")
    return profiles.join(extra, "id", "left").withColumn("codes", F.coalesce("codes", none)).withColumn("known", F.array_union("codes", F.coalesce("others", none))).drop("others")


def name_keys(profiles: DataFrame, asks: bool) -> DataFrame:
    def forms(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                rows = [(s, k) for s in part["spoken"] for k in name_forms(s, asks)]
                yield pd.DataFrame(rows, columns=["spoken", "k"])

    # a name's forms are made once, whoever bears it, and the names spread over all tasks
    tasks = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heard = profiles.where("spoken IS NOT NULL").select("spoken").distinct().repartition(tasks, F.xxhash64("spoken"))
    made = heard.mapInPandas(forms, "spoken string, k string").select("spoken", F.xxhash64("k").alias("k"))
    return profiles.where("spoken IS NOT NULL").select("id", "spoken").join(made.hint("merge"), "spoken").select("id", "k")


def keys(profiles: DataFrame, asks: bool) -> DataFrame:
    plain = [profiles.where(F.col(c).isNotNull()).select("id", F.xxhash64(F.lit(c), c).alias("k")) for c in ("cid", "key", "bank")]
    codes = profiles.select("id", F.explode("known").alias("c")).select("id", F.xxhash64(F.lit("code"), "c").alias("k"))
    out = name_keys(profiles, asks).unionByName(codes)
    for p in plain:
        out = out.unionByName(p)
    return out


def name_votes(batches):
    """Adds the vote on names to pairs: for within two slips, against beyond or where one names a derivative of the other."""
    for pdf in batches:
        near = []
        for a, b, x, y in zip(pdf["l_name"], pdf["r_name"], pdf["l_spoken"], pdf["r_spoken"], strict=True):
            a, b = ([] if v is None else list(v) for v in (a, b))
            if not x or not y:
                near.append(0)
                continue
            far = min([names.slips(x, y), *(names.slips(p, q) for p in a for q in b)])
            inner = min((names.slips(u, w) for p, q in ((x, y), (y, x), *((p, q) for p in a for q in b), *((q, p) for p in a for q in b)) if (u := names.underived(p)) for w in [q]), default=99)
            made = inner < far and inner <= 2
            near.append(1 if far <= 2 and not made else -1)
        yield pdf.assign(name=near)[["l", "r", *VOTES]].astype({v: "int32" for v in VOTES})


def votes(left: DataFrame, right: DataFrame) -> DataFrame:
    """The candidates (l, r) and the vote of every function."""
    pairs = keys(left, False).withColumnRenamed("id", "l").join(keys(right, True).withColumnRenamed("id", "r"), "k").select("l", "r").distinct()
    both = pairs.join(left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]), F.col("l") == F.col("l_id")).join(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), F.col("r") == F.col("r_id"))

    def same(c: str) -> Column:
        return F.when(F.col(f"l_{c}").isNull() | F.col(f"r_{c}").isNull(), 0).when(F.col(f"l_{c}") == F.col(f"r_{c}"), 1).otherwise(-1).alias(c)

    def meet(c: str) -> Column:
        return F.when((F.size(f"l_{c}") <= 0) | (F.size(f"r_{c}") <= 0), 0).when(F.arrays_overlap(f"l_{c}", f"r_{c}"), 1).otherwise(-1)

    direct, known = meet("codes"), meet("known")
    scored = both.select("l", "r", "l_name", "r_name", "l_spoken", "r_spoken", same("cid"), same("key"), same("bank"), direct.alias("code"), F.when(direct != 0, 0).otherwise(known).alias("alias"))
    kinds = f"l {left.schema['id'].dataType.simpleString()}, r {right.schema['id'].dataType.simpleString()}, " + ", ".join(f"{v} int" for v in VOTES)
    return scored.mapInPandas(name_votes, kinds)


class LabelModel:
    """Two classes; a function that has an opinion errs at a rate of its class, which may hang on one other function's vote.

    That a function has none says nothing about the class.  The prior takes every function for better than chance.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, right: float = 4.0, wrong: float = 1.0, dependence: float = 0.005):
        self.v = patterns + 1  # votes as 0, 1, 2
        self.n = counts.astype(float)
        self.prior = np.zeros((2, 3, 3))
        self.prior[0, :, 0], self.prior[0, :, 2] = right, wrong
        self.prior[1, :, 0], self.prior[1, :, 2] = wrong, right
        self.parent = [-1] * patterns.shape[1]
        self.q = 1 / (1 + np.exp(-1.5 * patterns.sum(1)))
        self.run(rounds)
        self.parent = self.forest(dependence)
        self.run(rounds)

    def run(self, rounds: int) -> None:
        for _ in range(rounds):
            weight = np.stack([(1 - self.q) * self.n, self.q * self.n])
            log = np.log(weight.sum(1) + 1)[:, None] + np.zeros((2, len(self.n)))
            for j, p in enumerate(self.parent):
                own = self.v[:, j]
                by = self.v[:, p] if p >= 0 else np.ones(len(own), int)
                table = self.prior.copy()
                for y in (0, 1):
                    np.add.at(table[y], (by, own), weight[y])
                table[:, :, 1] = 0
                table /= table.sum(2, keepdims=True)
                table[:, :, 1] = 1
                log += np.log(table[:, by, own])
            self.q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))

    def forest(self, least: float) -> list[int]:
        """Each function's parent in the forest of greatest mutual information within the classes."""
        m = self.v.shape[1]
        links = []
        for i in range(m):
            for j in range(i):
                info = 0.0
                for w in ((1 - self.q) * self.n, self.q * self.n):
                    t = np.zeros((3, 3))
                    np.add.at(t, (self.v[:, i], self.v[:, j]), w)
                    t[1], t[:, 1] = 0, 0  # where both have an opinion
                    if t.sum() > 0:
                        t /= self.n.sum()
                        with np.errstate(divide="ignore", invalid="ignore"):
                            info += np.nansum(t * np.log(t * t.sum() / (t.sum(1, keepdims=True) * t.sum(0, keepdims=True))))
                links.append((info, i, j))
        tree = list(range(m))
        near: dict[int, list[int]] = {i: [] for i in range(m)}

        def top(i: int) -> int:
            while tree[i] != i:
                i = tree[i]
            return i

        for info, i, j in sorted(links, reverse=True):
            if info > least and top(i) != top(j):
                tree[top(i)] = top(j)
                near[i].append(j)
                near[j].append(i)
        parent, seen = [-1] * m, set()
        for root in range(m):
            stack = [] if root in seen else [root]
            seen.update(stack)
            while stack:
                i = stack.pop()
                for j in near[i]:
                    if j not in seen:
                        parent[j] = i
                        seen.add(j)
                        stack.append(j)
        return parent


def confidences(voted: DataFrame) -> DataFrame:
    """(votes..., confidence) for every way to vote that occurs: at most 3 to the number of functions rows."""
    ways = voted.groupBy(*VOTES).count().orderBy(*VOTES).collect()
    schema = ", ".join(f"{v} int" for v in VOTES) + ", confidence double"
    if not ways:
        return voted.sparkSession.createDataFrame([], schema)
    model = LabelModel(np.array([[r[v] for v in VOTES] for r in ways]), np.array([r["count"] for r in ways]))
    return voted.sparkSession.createDataFrame([(*[r[v] for v in VOTES], round(float(q), 6)) for r, q in zip(ways, model.q, strict=True)], schema)


def linked(assays: DataFrame, xref: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(drug_id, xref_id, confidence) of every candidate pair.

    Null ids make no entity; null names and identifiers have no opinion; repeated rows count once; controls and
    mixtures are no candidates.  Either side empty gives no rows.  ``terms`` (term_name, synonyms) may tell
    further names that go together.
    """
    left, a = left_profiles(assays)
    right, b = right_profiles(xref)
    together = a.unionByName(b)
    if terms is not None:
        t = terms.select("term_name", F.explode(F.split(F.coalesce("synonyms", F.lit("")), ";")).alias("s"))
        words = said(t.select(F.col("term_name").alias("value")).union(t.select("s")))
        x, y = words.select(F.col("value").alias("term_name"), "spoken"), words.select(F.col("value").alias("s"), "codes")
        together = together.unionByName(t.join(x, "term_name").join(y, "s").select(F.explode("codes").alias("code"), "spoken", F.lit(1).alias("n")))
    # a code goes with the name that it is most often seen with
    alias = commonest(together, "code", "spoken", "n").select("code", F.col("values")[0].alias("spoken"))
    alias = checkpointed(alias)
    left, right = checkpointed(with_alias(left, alias)), checkpointed(with_alias(right, alias))
    voted = checkpointed(votes(left, right))
    return voted.join(F.broadcast(confidences(voted)), list(VOTES)).select(F.col("l").alias("drug_id"), F.col("r").alias("xref_id"), "confidence")
