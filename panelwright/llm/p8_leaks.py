"""Problem 8: passages of held-out texts inside a corpus, by Wu-Manber's multi-pattern search over words.

A passage of n successive words of which at most one is changed holds n // 2 successive unchanged ones, so
all windows of that many words are the patterns.  Texts become word numbers; a shift table by pairs of words
skips positions where no window can end, a bucket by the last pair selects the windows that may, and direct
comparison confirms.  A confirmed window is then read in both directions, over at most one changed word.
"""

from __future__ import annotations

import html
import math
import pickle
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.names import plain
from panelwright.session import checkpointed

TAG = re.compile(r"</?[a-zA-Z!][^<>]{0,200}>|\[/?[a-zA-Z*]+(?:=[^\[\]]{0,200})?\]")
WORD = re.compile(r"[^\W_]+")
SHARD_WORDS = 200_000  # words of held-out texts in one table, about
PASS_BYTES = 256 << 20  # of tables that go to every task at once; more are searched in a further pass over the corpus


def words_of(text: str) -> list[str]:
    """The words of a text, without letter case, markup, entities, accents and look-alike letters."""
    for _ in range(2):
        text = html.unescape(text)
    s = plain(TAG.sub(" ", text))
    return [w if w.isdigit() else w.replace("0", "o").replace("1", "l") for w in WORD.findall(s)]


class WuManber:
    """All windows of ``m`` words of the items, searched at once; some twenty bytes a word, in arrays."""

    def __init__(self, items: list[tuple[int, str]], m: int):
        self.m = m
        self.ids: dict[str, int] = {}
        self.names = [i for i, _ in items]
        numbered = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(t)], np.int64) for _, t in items]
        self.starts = np.cumsum([0, *map(len, numbered)])
        self.words = np.concatenate([*numbered, np.zeros(0, np.int64)])
        at = np.concatenate([*[np.arange(lo, lo + len(w) - m + 1) for lo, w in zip(self.starts[:-1], numbered, strict=True)], np.zeros(0, np.int64)]).astype(np.int64)
        # how far the end of any window is at least from a pair of words
        pairs, shifts = [], []
        for j in range(1, m):
            pairs.append(self.pair(self.words[at + j - 1], self.words[at + j]))
            shifts.append(np.full(len(at), m - 1 - j, np.int8))
        pairs, shifts = np.concatenate(pairs), np.concatenate(shifts)
        order = np.lexsort((shifts, pairs))
        self.pairs, first = np.unique(pairs[order], return_index=True)
        self.shifts = shifts[order][first]
        # the windows, by the pair that they end on
        ends = self.pair(self.words[at + m - 2], self.words[at + m - 1])
        order = np.argsort(ends, kind="stable")
        self.windows, self.ends = at[order], ends[order]

    @classmethod
    def of(cls, state: dict) -> WuManber:
        table = cls.__new__(cls)
        vars(table).update(state)
        return table

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a << 32 | b

    def numbers(self, text: str) -> list[int]:
        get = self.ids.get
        return [get(w, 0) for w in words_of(text)]

    def search(self, text: list[int]) -> list[tuple[int, int, int]]:
        """(item's place, place in the item, place in the text) of every window that occurs; an unknown word, 0, is in none."""
        m, t, found = self.m, np.array(text, np.int64), []
        if len(t) < m or not len(self.pairs):
            return found
        here = self.pair(t[m - 2 : -1], t[m - 1 :])
        at = np.minimum(np.searchsorted(self.pairs, here), len(self.pairs) - 1)
        # a pair that isn't known, or isn't the end of a window, can't end one
        for i in np.flatnonzero((self.pairs[at] == here) & (self.shifts[at] == 0)):
            lo, hi = np.searchsorted(self.ends, here[i], "left"), np.searchsorted(self.ends, here[i], "right")
            w = self.windows[lo:hi]
            for k in w[(self.words[w[:, None] + np.arange(m)] == t[i : i + m]).all(1)]:
                item = int(np.searchsorted(self.starts, k, "right")) - 1
                found.append((item, int(k - self.starts[item]), int(i)))
        return found

    def passage(self, item: int, k: int, text: list[int], start: int) -> int:
        """The length of the longest passage around a window, with at most one changed word."""
        w = self.words[self.starts[item] : self.starts[item + 1]]

        def run(i: int, j: int, step: int) -> int:
            n = 0
            while 0 <= i < len(w) and 0 <= j < len(text) and w[i] == text[j]:
                i, j, n = i + step, j + step, n + 1
            return n

        left, right = run(k - 1, start - 1, -1), run(k + self.m, start + self.m, 1)
        core = left + self.m + right
        low, high = k - left - 1, k + self.m + right  # the changed word before, or after
        before = 1 + run(low - 1, start - left - 2, -1) if low >= 0 and start - left - 1 >= 0 else 0
        after = 1 + run(high + 1, start + self.m + right + 1, 1) if high < len(w) and start + self.m + right < len(text) else 0
        return core + max(before, after)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int = 12) -> DataFrame:
    """(doc_id, item_id, words): the documents that hold ``n`` or more successive words of an item, at most one changed.

    ``words`` is the longest such passage.  A word that is lost, added or split breaks a passage.  Null or empty texts
    and items shorter than ``n`` words leak nothing; null ids are no documents; of rows that repeat an id each counts,
    the result is distinct.  Whole texts are read, in whole tables.  Tables are built by shards of the items, as Spark
    tasks; all that fit PASS_BYTES go to every task and are searched in one reading of the corpus.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc {kind}, item {item_kind}, words int"
    held = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct()
    size = held.agg(F.sum(F.length("text") - F.length(F.translate("text", " ", "")) + 1)).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_WORDS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        table = WuManber(sorted(zip(pdf["item"].tolist(), pdf["text"].tolist(), strict=True)), n // 2)
        return pd.DataFrame({"table": [pickle.dumps(vars(table), protocol=5)]})

    tables = checkpointed(held.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(shards)).alias("shard")).applyInPandas(build, "table binary"))
    corpus = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)

    def scan(sent):
        def run(batches):
            known = [WuManber.of(pickle.loads(b)) for b in sent.value]
            for pdf in batches:
                rows = []
                ids, said = pdf["doc"].tolist(), [words_of(t) for t in pdf["text"]]
                for table in known:
                    get = table.ids.get
                    numbers = [[get(w, 0) for w in words] for words in said]
                    # all texts of the batch as one, with an unknown word between them
                    starts = np.cumsum([0, *[len(x) + 1 for x in numbers]])
                    best: dict[tuple[int, int], int] = {}
                    for i, k, at in table.search([w for x in numbers for w in (*x, 0)]):
                        d = int(np.searchsorted(starts, at, "right")) - 1
                        best[d, i] = max(best.get((d, i), 0), table.passage(i, k, numbers[d], at - int(starts[d])))
                    rows += [(ids[d], table.names[i], b) for (d, i), b in best.items() if b >= n]
                yield pd.DataFrame(rows, columns=["doc", "item", "words"]).astype({"words": "int32"})

        return run

    part: list[bytes] = []
    for blob in [*(bytes(r[0]) for r in tables.toLocalIterator()), None]:  # a shard at a time
        if part and (blob is None or sum(map(len, part)) + len(blob) > PASS_BYTES):
            out = out.unionByName(corpus.mapInPandas(scan(spark.sparkContext.broadcast(part)), schema))
            part = []
        part = [*part, blob] if blob is not None else part
    return out.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("words").alias("words"))
