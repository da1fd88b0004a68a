"""Problem 4: the k most similar vectors of every vector, by an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is indexed and every vector is a query.
Lists are kept short, their number grows with the table.  A query is first answered inside its own list, where it
lies anyway; the k-th similarity found there and the reach of the other lists then say, by the triangle inequality,
which of its ``nprobe`` nearest lists can still hold a better one, and only those are asked.  In a list the asymmetric
distance table of the query scores every code; the stored norm of what the code loses turns the score into bounds, so
that only vectors that may still be among the k best are reranked exactly, and none is lost to quantisation.  Only
``nprobe`` costs accuracy; without it every list that the bound leaves is asked, and the answer is exact.

Exact copies share one index entry that carries the first k + 1 of their ids, so a group of copies that holds a third
of all rows costs one entry; long lists are cut into blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.session import checkpointed

SAMPLE_ROWS = 20_000  # rows that the centroids and codebooks are fitted on, at most
LIST_ROWS = 32  # rows of a list, on average, as long as there are fewer than MAX_LISTS
MAX_LISTS = 1 << 16  # beyond it lists grow; what is known of each list goes to every task
MAX_COARSE = 2_500  # lists that have a centroid of their own; beyond it each is divided by centroids of residuals
BLOCK_ROWS = 2048  # rows of one list in one task step
BLOCK_ASKED = 8192  # queries of one list in one task step
SUBSPACES = 16
CODES = 256


def usable_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(id, raw) of the rows whose vector has ``size`` finite values that aren't all zero."""
    v = F.col(vector)
    fine = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & v.isNotNull() & fine).select(F.col(key).alias("id"), v.cast("array<float>").alias("raw"))


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(at, minlength=len(c))
        for d in range(x.shape[1]):
            total = np.bincount(at, weights=x[:, d], minlength=len(c))
            c[:, d] = np.where(n > 0, total / np.maximum(n, 1), c[:, d])
    return c


def unpacked(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


class Index:
    """The fitted model: coarse centroids, centroids of their residuals (one, zero, if lists are few), and a codebook for each subspace.

    A list is a pair of the two.  All of it is bounded, so it goes to every task.
    """

    def __init__(self, coarse: np.ndarray, fine: np.ndarray, books: np.ndarray | None = None):
        self.coarse, self.fine, self.books = coarse, fine, books
        self.centroids = (coarse[:, None, :] + fine[None, :, :]).reshape(-1, coarse.shape[1])
        self.half = (self.centroids**2).sum(1) / 2

    def lists(self, x: np.ndarray) -> np.ndarray:
        a = (x @ self.coarse.T - (self.coarse**2).sum(1) / 2).argmax(1)
        rest = x - self.coarse[a]
        return a * len(self.fine) + (rest @ self.fine.T - (self.fine**2).sum(1) / 2).argmax(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, distance from the list's centroid, and the norm that the codes lose, of unit vectors."""
        at = self.lists(x)
        rest = x - self.centroids[at]
        reach = np.linalg.norm(rest, axis=1)
        codes = np.empty((len(x), len(self.books)), np.uint8)
        step = x.shape[1] // len(self.books)
        for m, book in enumerate(self.books):
            part = rest[:, m * step : (m + 1) * step]
            codes[:, m] = (part @ book.T - (book**2).sum(1) / 2).argmax(1)
            rest[:, m * step : (m + 1) * step] -= book[codes[:, m]]
        return at, codes, reach, np.linalg.norm(rest, axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """The asymmetric tables of queries: inner products with every code of every subspace."""
        step = q.shape[1] // len(self.books)
        return np.stack([q[:, m * step : (m + 1) * step] @ book.T for m, book in enumerate(self.books)], 1)


def centroids_of(sample: DataFrame, column: str, k: int, dim: int, rounds: int, seed: int, less: np.ndarray | None = None) -> np.ndarray:
    """``k`` means of the sample's vectors (or of their residuals from the nearest row of ``less``); each round adds up where the rows are."""
    rows = sample.orderBy(F.xxhash64("rep", F.lit(seed))).limit(k).select(column).collect()  # at most MAX_COARSE
    start = np.array([r[0] for r in rows])

    def rest_of(x: np.ndarray) -> np.ndarray:
        return x if less is None else x - less[(x @ less.T - (less**2).sum(1) / 2).argmax(1)]

    c = rest_of(start)

    def sums(batches):
        for pdf in batches:
            if len(pdf):
                x = rest_of(np.array(pdf["u"].tolist()))
                at = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
                order = np.argsort(at, kind="stable")
                held, first, n = np.unique(at[order], return_index=True, return_counts=True)
                yield pd.DataFrame({"at": held, "n": n, "total": np.add.reduceat(x[order], first).tolist()})

    for _ in range(rounds):
        total, n = np.zeros_like(c), np.zeros(len(c))
        for r in sample.select(F.col(column).alias("u")).mapInPandas(sums, "at int, n long, total array<double>").collect():  # k rows a task
            total[r["at"]] += r["total"]
            n[r["at"]] += r["n"]
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(reps: DataFrame, dim: int, n: int, seed: int) -> Index:
    sample = checkpointed(reps.orderBy(F.xxhash64("rep")).limit(SAMPLE_ROWS).select("rep", F.transform("unit", lambda x: x.cast("double")).alias("u")).repartition(8))
    lists = max(1, min(MAX_LISTS, n // LIST_ROWS))
    coarse = centroids_of(sample, "u", min(lists, MAX_COARSE), dim, 6, seed) if lists > 1 else np.zeros((1, dim))
    fine = np.zeros((1, dim)) if lists <= MAX_COARSE else centroids_of(sample, "u", math.ceil(lists / MAX_COARSE), dim, 6, seed + 1, coarse)
    index = Index(coarse, fine)
    step = dim // SUBSPACES

    def book(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = lloyd(np.array(pdf["part"].tolist()), CODES, 8, seed + key[0])
        return pd.DataFrame({"m": key[0], "code": range(len(c)), "at": c.tolist()})

    def parts(batches):
        for pdf in batches:
            x = np.array(pdf["u"].tolist())
            if len(x):
                rest = x - index.centroids[index.lists(x)]
                for m in range(SUBSPACES):
                    yield pd.DataFrame({"m": m, "part": rest[:, m * step : (m + 1) * step].tolist()})

    rows = sample.mapInPandas(parts, "m int, part array<double>").groupBy("m").applyInPandas(book, "m int, code int, at array<double>").collect()
    books = np.zeros((SUBSPACES, max(r["code"] for r in rows) + 1, step))
    for r in rows:
        books[r["m"], r["code"]] = r["at"]
    return Index(coarse, fine, books)


def most_similar(df: DataFrame, key: str, vector: str, size: int, k: int = 5, least: float = 0.8, decimals: int = 6, nprobe: int | None = 8, seed: int = 7) -> DataFrame:
    """The ``k`` most similar other rows of every row, as (id, other, similarity, rank).

    Similarity is the cosine, rounded to ``decimals``; only similarities of ``least`` or more count; of equals
    the smaller id goes first.  Rows without ``size`` finite values that aren't all zero, or without a key,
    take no part; repeated rows count once.  An empty table gives no rows; further columns are ignored.
    ``nprobe`` is the number of lists a query may meet (four times as many where lists are divided by residuals, whose
    borders part more neighbours), None all of them.  ``size`` must be a multiple of 16.
    """
    spark = df.sparkSession
    own = usable_vectors(df, key, vector, size).dropDuplicates(["id", "raw"])
    own = own.withColumn("rep", F.concat_ws("-", F.xxhash64("raw").cast("string"), F.hash("raw").cast("string")))
    own = checkpointed(own)
    reps = own.groupBy("rep").agg(F.first("raw").alias("raw"), F.min("id").alias("first"))
    # the first ids of a group of copies: by partial lists, since a group may hold a third of all rows
    w = W.partitionBy("rep", "salt").orderBy("id")
    salted = own.select("rep", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    heads = salted.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    reps = checkpointed(reps.join(heads, "rep").withColumn("unit", F.transform("raw", lambda x: x.cast("double") / norm)))
    n = reps.count()
    if not n:
        return spark.createDataFrame([], f"{key} string, other string, similarity double, rank int")
    index = fit(reps, size, n, seed)
    probes = nprobe if nprobe is None or len(index.fine) == 1 else 4 * nprobe
    id_type = own.schema["id"].dataType.simpleString()
    kinds = f"first {id_type}, ids array<{id_type}>"

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                raw = np.array(pdf["raw"].tolist(), np.float32)
                at, codes, reach, lost = index.encode(unit(raw))
                yield pd.DataFrame({"list": at, "q": pdf["q"], "raw": [r.tobytes() for r in raw], "codes": [c.tobytes() for c in codes], "reach": reach, "lost": lost, "first": pdf["first"], "ids": pdf["ids"]})

    named_reps = reps.select("rep", F.monotonically_increasing_id().alias("q"))  # of a checkpoint, so the same in every run
    coded = reps.select(F.monotonically_increasing_id().alias("q"), "raw", "first", "ids").mapInPandas(encode, f"list int, q long, raw binary, codes binary, reach double, lost double, {kinds}")
    coded = checkpointed(coded)
    blocks = np.zeros(len(index.centroids), int)
    reach = np.full(len(index.centroids), -9.0)
    for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect():  # at most MAX_LISTS rows
        blocks[r["list"]], reach[r["list"]] = math.ceil(r["n"] / BLOCK_ROWS), r["reach"]

    def best_of(q: np.ndarray, asked: list, stored: pa.Table, at: int) -> tuple[dict, np.ndarray]:
        """The k + 1 best of a block for each query, and each one's k-th best similarity of another vector."""
        found = {"q": [], "similarity": [], "first": [], "ids": []}
        kth = np.full(len(q), -9.0)
        raw = unit(unpacked(stored["raw"], size))
        codes = np.frombuffer(b"".join(stored["codes"].to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        lost = stored["lost"].to_numpy()
        firsts, ids, names = stored["first"].to_pylist(), stored["ids"].to_pylist(), stored["q"].to_pylist()
        by_first = np.empty(len(firsts), int)
        by_first[sorted(range(len(firsts)), key=firsts.__getitem__)] = np.arange(len(firsts))
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256]
            table = index.tables(part)
            guess = np.repeat((part @ index.centroids[at])[:, None], len(raw), 1)
            for m in range(SUBSPACES):
                guess += table[:, m][:, codes[:, m]]
            floor = np.full(len(part), least)
            if len(raw) > k + 1:
                floor = np.maximum(floor, np.partition(guess - lost, -(k + 1), axis=1)[:, -(k + 1)])
            may = guess + lost >= floor[:, None] - 2 * 10.0**-decimals
            for i in np.flatnonzero(may.any(1)):
                c = np.flatnonzero(may[i])
                exact = np.round(raw[c] @ part[i], decimals)
                c, exact = c[exact >= least], exact[exact >= least]
                order = np.lexsort((by_first[c], -exact))[: k + 1]
                others = [float(exact[j]) for j in order if names[c[j]] != asked[lo + i] for _ in ids[c[j]]]
                kth[lo + i] = others[k - 1] if len(others) >= k else -9.0
                for j in order:
                    for name, x in zip(found, (asked[lo + i], float(exact[j]), firsts[c[j]], ids[c[j]]), strict=True):
                        found[name].append(x)
        return found, kth

    def at_home(block: pa.Table) -> pa.Table:
        """Hits inside the block, and which further blocks may hold better ones; both in one table, told apart by ``list``."""
        at, here = block["list"][0].as_py(), block["b"][0].as_py()
        q, names, raws = unit(unpacked(block["raw"], size)), block["q"].to_pylist(), block["raw"].to_pylist()
        found, kth = best_of(q, names, block, at)
        out = {"list": [None] * len(found["q"]), "b": [None] * len(found["q"]), "qraw": [None] * len(found["q"])} | found
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256]
            dot = part @ index.centroids.T
            far = np.sqrt(np.maximum(1 - 2 * dot + 2 * index.half, 0))  # of the query from each centroid
            # no vector of a list is nearer than the list's centroid is, less the list's reach
            near = np.maximum(far - reach, 0)
            within = near <= np.sqrt(2 - 2 * np.minimum(np.maximum(kth[lo : lo + 256], least), 1))[:, None] + 1e-3
            within &= (blocks > 0)[None, :]
            if probes is not None and probes < far.shape[1]:
                taken = np.argpartition(far, probes - 1, axis=1)[:, :probes]
                chosen = np.zeros_like(within)
                np.put_along_axis(chosen, taken, True, axis=1)
                within &= chosen
            within[:, at] |= blocks[at] > 1
            for i, j in zip(*np.nonzero(within), strict=True):
                for b in range(blocks[j]):
                    if j != at or b != here:
                        for name, x in (("list", int(j)), ("b", b), ("qraw", raws[lo + i]), ("q", names[lo + i]), ("similarity", None), ("first", None), ("ids", None)):
                            out[name].append(x)
        return pa.Table.from_pydict(out, schema=both)

    def elsewhere(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"q": [], "similarity": [], "first": [], "ids": []}
        if left.num_rows and right.num_rows:
            found, _ = best_of(unit(unpacked(left["qraw"], size)), left["q"].to_pylist(), right, left["list"][0].as_py())
        return pa.Table.from_pydict(found, schema=hit)

    hit = pa.schema([("q", pa.int64()), ("similarity", pa.float64()), ("first", arrow_type(id_type)), ("ids", pa.list_(arrow_type(id_type)))])
    both = pa.schema([("list", pa.int32()), ("b", pa.int32()), ("qraw", pa.binary()), *hit])
    sizes = spark.createDataFrame([(int(a), int(b)) for a, b in enumerate(blocks) if b], "list int, blocks int")  # at most MAX_LISTS rows
    stored = coded.join(F.broadcast(sizes), "list").withColumn("b", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks", "reach")
    first_round = checkpointed(stored.groupBy("list", "b").applyInArrow(at_home, f"list int, b int, qraw binary, q long, similarity double, {kinds}"))
    asked = first_round.where("list IS NOT NULL").select("list", "b", "q", "qraw")
    # stored rows go only to the blocks of queries that ask their list
    asks = asked.groupBy("list", "b").agg(F.count("*").alias("n")).select("list", "b", F.ceil(F.col("n") / BLOCK_ASKED).cast("int").alias("parts"))
    asks = checkpointed(asks)
    asks = F.broadcast(asks)  # at most MAX_LISTS rows, and one for each BLOCK_ROWS of the table
    asked = asked.join(asks, ["list", "b"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
    given = stored.join(asks, ["list", "b"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    second_round = asked.groupBy("list", "b", "part").cogroup(given.groupBy("list", "b", "part")).applyInArrow(elsewhere, f"q long, similarity double, {kinds}")
    # each block gives a query at most k + 1 rows
    hits = first_round.where("list IS NULL").select("q", "similarity", "first", "ids").unionByName(second_round)
    best = W.partitionBy("q").orderBy(F.desc("similarity"), "first")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    named = hits.select("q", "similarity", F.explode("ids").alias("other"))
    order = W.partitionBy("q").orderBy(F.desc("similarity"), "other")
    named = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    answer = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "other", "similarity"))).alias("near"))
    # to each copy the answer of its entry, without itself; a hot entry is split by the adaptive skew join
    each = own.select("rep", "id").distinct().join(named_reps.join(answer, "q").select("rep", "near"), "rep")
    each = each.select("id", F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k).alias("near"))
    return each.select(F.col("id").alias(key), F.posexplode("near").alias("p", "x")).select(key, F.col("x.other").alias("other"), F.col("x.similarity").alias("similarity"), (F.col("p") + 1).alias("rank"))


def arrow_type(name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]
