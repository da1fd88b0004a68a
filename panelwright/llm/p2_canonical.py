"""Problem 2: freely typed values led to the entry of a reference list that they mean.

Entries stand in BK-trees under Levenshtein's metric, one tree a shard of the list, built once.  Values are read
into forms; the distinct forms that are no entry search every shard, the triangle inequality prunes, all entries
within the radius come back, and the winners of the shards are merged.  Rows never meet the trees, only distinct
forms do, and everything else is joins.
"""

from __future__ import annotations

import math
import pickle

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import names
from panelwright.session import checkpointed

SHARD_ENTRIES = 5_000  # of the reference list in one tree
BLOCK_FORMS = 5_000  # distinct forms that one task step searches, at most
MAX_WORDS = 1_000_000  # of the list's phrases, which open abbreviations; a list with more is refused
READERS = {"drug_name": "substance"}  # fields read as names of substances; the others are read as phrases
PART = "field string, value string, role string, tier string, form string"


def allowed(c: str) -> Column:
    """Slips that a form of this length may hold."""
    n = F.length(c)
    return F.when(n >= 20, 3).when(n >= 9, 2).when(n >= 7, 1).otherwise(0)


def within(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(tree, q, e, slips): the ``entries`` (tree, e) within ``r`` slips of ``queries`` (tree, q, r).

    A change of places is one slip but two of Levenshtein's edits, so trees are searched twice as far.  Every query
    searches every shard of its tree; a shard's tree is built once and goes to the blocks of queries as bytes.
    """
    spark = queries.sparkSession
    entries, queries = entries.distinct(), checkpointed(queries.distinct())
    counts = {r[0]: r[1] for r in entries.groupBy("tree").count().collect()}  # a row for each field and tier
    tasks, n = int(spark.conf.get("spark.sql.shuffle.partitions")), queries.count()
    if not counts or not n:
        return spark.createDataFrame([], "tree string, q string, e string, slips int")
    blocks = max(tasks, math.ceil(n / BLOCK_FORMS))
    shards = F.coalesce(*[F.when(F.col("tree") == t, F.lit(math.ceil(k / SHARD_ENTRIES))) for t, k in counts.items()], F.lit(0))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [key[0]], "shard": [key[1]], "nodes": [pickle.dumps(names.BKTree(pdf["e"].tolist()).root)]})

    trees = entries.withColumn("shard", F.pmod(F.xxhash64("e"), shards).cast("int")).groupBy("tree", "shard").applyInPandas(build, "tree string, shard int, nodes binary")
    trees = checkpointed(trees).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.where(shards > 0).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            tree = names.BKTree([])
            tree.root = pickle.loads(right["nodes"].iloc[0])
            for q, r in zip(left["q"].tolist(), left["r"].tolist(), strict=True):
                rows += [(key[0], q, e, d) for _, e in tree.within(q, 2 * r) if (d := names.slips(q, e)) <= r]
        return pd.DataFrame(rows, columns=["tree", "q", "e", "slips"]).astype({"slips": "int32"})

    # little to move but much to compute: as many tasks as the session has shuffle partitions, never merged
    keys = ["tree", "shard", "block"]
    asked, trees = asked.repartition(tasks, *keys), trees.repartition(tasks, *keys)
    return asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(search, "tree string, q string, e string, slips int")


def parts_of(values: DataFrame, readers: dict[str, str], words: list[str], longest: int) -> DataFrame:
    """(field, value, role, tier, form): how each (field, value) may be read.

    Role 'own' is the value, 'inner' what is left of it without a leading part that makes a derivative; tier 'name'
    is as written, 'heard' by sound, 'code' a laboratory's code.
    """
    known = set(words)

    def read(batches):
        for pdf in batches:
            rows = []
            for f, v in zip(pdf["field"], pdf["value"], strict=True):
                if readers.get(f) != "substance":
                    rows += [(f, v, "own", "name", x) for x in names.diagnosis_forms(v, known, longest)]
                    continue
                s = names.substance(v)
                if s["kind"] == "code":
                    rows += [(f, v, "own", "code", c) for c in s["codes"]]
                elif s["kind"] == "name":
                    for role, x in (("own", s["name"]), ("inner", names.underived(s["name"]))):
                        rows += [(f, v, role, "name", x), (f, v, role, "heard", names.spoken(x))] if x else []
            yield pd.DataFrame(rows, columns=["field", "value", "role", "tier", "form"])

    return values.select("field", "value").mapInPandas(read, PART)


def entries_of(terms: DataFrame, readers: dict[str, str]) -> DataFrame:
    """(field, tier, form, term_id) of every name and synonym."""

    def read(batches):
        for pdf in batches:
            rows = []
            for f, i, x in zip(pdf["field"], pdf["term_id"], pdf["said"], strict=True):
                if readers.get(f) != "substance":
                    rows.append((f, "name", names.letters(names.plain(x)), i))
                    continue
                s = names.substance(x)
                rows += [(f, "name", s["name"], i), (f, "heard", names.spoken(s["name"]), i)] + [(f, "code", c, i) for c in s["codes"]]
            yield pd.DataFrame(rows, columns=["field", "tier", "form", "term_id"])

    said = terms.select("field", "term_id", F.explode(F.concat(F.array("term_name"), F.split(F.coalesce("synonyms", F.lit("")), ";"))).alias("said"))
    return said.mapInPandas(read, f"field string, tier string, form string, term_id {terms.schema['term_id'].dataType.simpleString()}").where("form <> ''").distinct()


def halves_of(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, form) of beginnings, and of endings, that two or more phrases of the list share with different rests."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for f, t in zip(pdf["field"], pdf["term_name"], strict=True):
                w = t.split()
                rows += [(f, names.letters(names.plain(" ".join(w[:i]))), names.letters(names.plain(" ".join(w[i:])))) for i in range(1, len(w))]
            yield pd.DataFrame(rows, columns=["field", "head", "tail"])

    cuts = checkpointed(terms.select("field", "term_name").distinct().mapInPandas(cut, "field string, head string, tail string").distinct())
    return tuple(cuts.groupBy("field", F.col(c).alias("form")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND form <> ''").select("field", "form") for c in ("head", "tail"))


def unlisted(near: DataFrame, terms: DataFrame, entries: DataFrame) -> DataFrame:
    """(field, form, slips): how near to each of ``near`` (field, form, d) a phrase is, within d, that isn't listed but made of a listed beginning and a listed ending.

    Such a phrase is another thing with a like name.  Beginnings and endings are searched apart, for every place where
    a form may be divided, and only those that fit together are compared whole; they are never all combined.
    """
    heads, tails = halves_of(terms)
    at = near.select("field", "form", "d", F.explode(F.sequence(F.lit(1), F.length("form") - 1)).alias("i")).where("length(form) > 1")
    at = at.select("field", "form", "d", "i", F.substring("form", F.lit(1), F.col("i")).alias("front"), F.substring("form", F.col("i") + 1, F.length("form")).alias("back"))
    # slips that fall on the place of division may count once more
    asked = [at.groupBy(F.concat(F.lit(f"{side} "), "field").alias("tree"), F.col(side).alias("q")).agg(F.max(F.col("d") + 1).alias("r")) for side in ("front", "back")]
    listed = [h.select(F.concat(F.lit(f"{side} "), "field").alias("tree"), F.col("form").alias("e")) for side, h in (("front", heads), ("back", tails))]
    hits = checkpointed(within(asked[0].unionByName(asked[1]), listed[0].unionByName(listed[1])))

    def side(name: str, e: str) -> DataFrame:
        return hits.where(F.col("tree").startswith(f"{name} ")).select(F.substring("tree", F.lit(len(name) + 2), F.length("tree")).alias("field"), F.col("q").alias(name), F.col("e").alias(e), F.col("slips").alias(f"d_{name}"))

    made = at.join(side("front", "head"), ["field", "front"]).join(side("back", "tail"), ["field", "back"]).where("d_front + d_back <= d + 1")
    made = made.select("field", "form", "d", F.concat("head", "tail").alias("whole")).distinct()
    made = made.join(entries.select("field", F.col("form").alias("whole")).distinct(), ["field", "whole"], "left_anti")

    def compare(batches):
        for pdf in batches:
            far = [names.slips(a, b) for a, b in zip(pdf["form"], pdf["whole"], strict=True)]
            yield pdf[["field", "form"]].assign(slips=pd.Series(far, index=pdf.index, dtype="int32"))

    return made.mapInPandas(compare, "field string, form string, slips int").groupBy("field", "form").agg(F.min("slips").alias("slips"))


def mapped_values(values: DataFrame, terms: DataFrame, readers: dict[str, str] | None = None) -> DataFrame:
    """(field, value, term_id) for every distinct non-blank ``values`` (field, value) that isn't exactly a term_name.

    ``terms`` has field_name, term_id, term_name and synonyms (separated by ';', may be null); ``readers`` says which
    fields are names of substances, the others are phrases.  term_id is the entry that the value means, else 'none':
    for a value beyond the slips its length allows, for two entries equally near, and for another thing with a like
    name.  Null and blank values have no row; repeated rows count once; without entries every value is 'none'.
    """
    readers = READERS if readers is None else readers
    terms = terms.where("term_id IS NOT NULL AND term_name IS NOT NULL").select(F.col("field_name").alias("field"), "term_id", "term_name", "synonyms").distinct()
    asked = values.select("field", "value").where(F.col("value").isNotNull() & (F.regexp_replace("value", r"[\s ​]+", "") != "")).distinct()
    asked = checkpointed(asked.join(terms.select("field", F.col("term_name").alias("value")).distinct(), ["field", "value"], "left_anti"))
    phrases = terms.where(~F.col("field").isin(*readers)) if readers else terms
    words = phrases.select(F.explode(F.split("term_name", r"\s+")).alias("w")).distinct().limit(MAX_WORDS + 1).collect()
    if len(words) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words in the list's phrases")
    entries = checkpointed(entries_of(terms, readers))
    longest = entries.agg(F.max(F.length("form"))).first()[0] or 0
    parts = checkpointed(parts_of(asked, readers, [names.letters(w) for r in words for w in names.plain(r["w"]).split()], longest))
    # what is written, or coded, as an entry is that entry
    exact = checkpointed(parts.where("tier <> 'heard'").join(entries, ["field", "tier", "form"]).select("field", "value", "role", "term_id", F.lit(0).alias("d")).distinct())
    open_parts = checkpointed(parts.where("tier <> 'code'").join(exact.select("field", "value", "role").distinct(), ["field", "value", "role"], "left_anti"))
    tree = F.concat_ws(" ", "tier", "field").alias("tree")
    heard = open_parts.where("tier = 'heard'").join(entries, ["field", "tier", "form"], "left_semi")
    queries = open_parts.join(heard.select("field", "tier", "form").distinct(), ["field", "tier", "form"], "left_anti").select(tree, F.col("form").alias("q"), allowed("form").alias("r")).where("r > 0")
    found = checkpointed(within(queries, entries.where("tier <> 'code'").select(tree, F.col("form").alias("e"))))
    near = found.union(heard.select(tree, F.col("form").alias("q"), F.col("form").alias("e"), F.lit(0).alias("slips")).distinct())
    near = near.join(entries.select(tree, F.col("form").alias("e"), "term_id"), ["tree", "e"]).groupBy("tree", F.col("q").alias("form"), "term_id").agg(F.min("slips").alias("slips"))
    later = F.when(F.col("tier") == "heard", 1).otherwise(0)  # by sound goes after what is written just so
    hits = open_parts.withColumn("tree", tree).join(near, ["tree", "form"]).select("field", "value", "role", "form", "term_id", (F.col("slips") + later).alias("d"))
    hits = checkpointed(hits)
    like = hits.where(~F.col("field").isin(*readers)) if readers else hits
    best = like.groupBy("field", "value").agg(F.min("d").alias("d"))
    turns = checkpointed(open_parts.join(best, ["field", "value"]).select("field", "value", "form", F.least("d", allowed("form")).alias("d")).where("d > 0"))
    decoy = unlisted(turns.groupBy("field", "form").agg(F.max("d").alias("d")), phrases, entries)
    apart = turns.join(decoy, ["field", "form"]).where("slips <= d").select("field", "value").distinct()
    near_all = hits.drop("form").unionByName(exact)
    own = near_all.where("role = 'own'").groupBy("field", "value", "term_id").agg(F.min("d").alias("d")).groupBy("field", "value").agg(F.sort_array(F.collect_list(F.struct("d", "term_id"))).alias("a"))
    inner = near_all.where("role = 'inner'").groupBy("field", "value").agg(F.min("d").alias("inner"))
    # the nearest entry, none if two are as near, or if the rest of a derivative's name is nearer
    clear = ((F.size("a") == 1) | (F.col("a")[0]["d"] < F.col("a")[1]["d"])) & ~F.coalesce(F.col("inner") < F.col("a")[0]["d"], F.lit(False))
    won = own.join(inner, ["field", "value"], "left").where(clear).select("field", "value", F.col("a")[0]["term_id"].alias("term_id")).join(apart, ["field", "value"], "left_anti")
    return asked.join(won, ["field", "value"], "left").select("field", "value", F.coalesce("term_id", F.lit("none")).alias("term_id"))


def mapped_records(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(field_name, record_id, term_id) of distinct ``records`` (field, record_id, value), as ``mapped_values`` says."""
    mapping = checkpointed(mapped_values(records, terms))
    rows = records.where("record_id IS NOT NULL").select("field", "record_id", "value")
    # a value typed in very many rows is split by the adaptive skew join
    return rows.join(mapping, ["field", "value"]).select(F.col("field").alias("field_name"), "record_id", "term_id").distinct()


def unmatched_values(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(field_name, value, records): every value that means no entry, and how many records hold it."""
    none = mapped_values(records, terms).where("term_id = 'none'").select("field", "value")
    held = records.where("record_id IS NOT NULL").select("field", "record_id", "value").distinct()
    return held.join(none, ["field", "value"]).groupBy(F.col("field").alias("field_name"), "value").agg(F.count(F.lit(1)).alias("records"))
