"""Problem 7: texts put into containers of fixed capacity, measured in tokens of a public tokenizer.

Large-item matching: of the documents above a third of the capacity at most two share a container, so each
one, from the largest down, is matched with the largest other that fits; smaller documents, from the largest
down, go into the gap they fill best.  Documents fall by hash into blocks of bounded size that are packed
apart, all at once; a block loses less than one container for it.
"""

from __future__ import annotations

import math
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_DOCS = 20_000


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, tokens) of every non-null text; special tokens in a text are ordinary text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for pdf in batches:
            sizes = []
            for lo in range(0, len(pdf), 64):
                sizes += [len(e.ids) for e in t.encode_batch(pdf["text"].iloc[lo : lo + 64].tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"doc": pdf["doc"], "tokens": pd.Series(sizes, dtype="int64")})

    own = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return own.mapInPandas(run, f"doc {kind}, tokens long")


def fill(sizes: list[int], capacity: int) -> list[int]:
    """A container for each size (1 to ``capacity``), counted from 0."""
    at = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    large = [i for i in order if sizes[i] * 3 > capacity]
    waiting: dict[int, list[int]] = {}
    mask = 0  # sizes that wait for a partner
    for i in reversed(large):
        waiting.setdefault(sizes[i], []).append(i)
        mask |= 1 << sizes[i]
    gaps: dict[int, list[int]] = {}
    holes = 0  # gaps that some container has
    n = 0

    def take(size: int) -> int:
        nonlocal mask
        i = waiting[size].pop()
        if not waiting[size]:
            mask &= ~(1 << size)
        return i

    def leave(container: int, gap: int) -> None:
        nonlocal holes
        if gap > 0:
            gaps.setdefault(gap, []).append(container)
            holes |= 1 << gap

    while mask:
        a = mask.bit_length() - 1
        at[take(a)] = n
        b = max(0, (mask & ((1 << (capacity - a + 1)) - 1)).bit_length() - 1)
        if b:
            at[take(b)] = n
        leave(n, capacity - a - b)
        n += 1
    for i in order[len(large) :]:
        s = sizes[i]
        if fits := holes >> s:
            gap = s + (fits & -fits).bit_length() - 1
            container = gaps[gap].pop()
            if not gaps[gap]:
                holes &= ~(1 << gap)
        else:
            container, gap, n = n, capacity, n + 1
        at[i] = container
        leave(container, gap - s)
    return at


def packed(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, container_id, doc, piece, first_token, tokens) from (doc, tokens) and (target_id, capacity_tokens).

    A document is one piece unless it alone exceeds the capacity; then it is divided into full containers and
    a rest.  Documents without tokens take no place; null ids, counts and capacities, and capacities below 1,
    don't count; repeated rows count once.  An empty table gives no rows.
    """
    kind = counts.schema["doc"].dataType.simpleString()
    target_kind = targets.schema["target_id"].dataType.simpleString()
    schema = f"target_id {target_kind}, container_id string, doc {kind}, piece int, first_token long, tokens long"
    own = checkpointed(counts.where("doc IS NOT NULL AND tokens > 0").select("doc", "tokens").distinct())
    blocks = max(1, math.ceil(own.count() / BLOCK_DOCS))
    sizes = targets.where("target_id IS NOT NULL AND capacity_tokens > 0").select("target_id", F.col("capacity_tokens").alias("capacity")).distinct()
    own = own.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))
    few = sizes.orderBy("target_id", "capacity").collect()  # a row for each kind of container
    if not few:
        return counts.sparkSession.createDataFrame([], schema)
    jobs = own.withColumn("t", F.explode(F.array(*[F.struct(F.lit(r[0]).alias("target_id"), F.lit(r[1]).alias("capacity")) for r in few]))).select("doc", "tokens", "block", "t.*")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        target, block, capacity = key[0], key[1], int(key[2])
        pieces = []
        for d, t in zip(pdf["doc"].tolist(), pdf["tokens"].tolist(), strict=True):
            pieces += [(d, k, lo, min(capacity, t - lo)) for k, lo in enumerate(range(0, t, capacity))]
        pieces.sort(key=lambda p: (p[0], p[1]))
        at = fill([p[3] for p in pieces], capacity)
        rows = [(target, f"{target}-{block}-{c}", d, k, lo, n) for (d, k, lo, n), c in zip(pieces, at, strict=True)]
        return pd.DataFrame(rows, columns=["target_id", "container_id", "doc", "piece", "first_token", "tokens"])

    return jobs.groupBy("target_id", "block", "capacity").applyInPandas(run, schema)


def fill_report(containers: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, containers, tokens, share): how full the containers are."""
    each = containers.groupBy("target_id", "container_id").agg(F.sum("tokens").alias("t")).groupBy("target_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    size = targets.groupBy("target_id").agg(F.max("capacity_tokens").alias("c"))
    return each.join(size, "target_id").select("target_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("c")), 6).alias("share"))
