"""Problem 9: texts that were cut, by a storage limit or in transfer.

Lengths are recomputed under other encodings, escapings and newline conversions; grouped by source and
measure, a hidden limit shows as one length that far more texts have than its neighbours, most of which
don't end.  Then endings are inspected: how often the corpus ends a sentence after the same last words, and
whether the last word is only the beginning of one.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.session import checkpointed

BYTES = ("utf8", "html_utf8", "json_utf8", "crlf_utf8")  # a cut may fall before a character of several bytes
DOTS = r"(?:\.{2,}|…)\s*$"
CLOSED = re.compile(r"""(?:[.!?:;)\]}>*~]|[.!?]["'»”’*_]+)\s*$""")
# at a limit only these are an end: a sentence's mark with what may close after it, or the close of a signature
ENDED = re.compile(r"""(?:[.!?]["'»”’)\]]*(?:\s|</?[a-zA-Z][^<>]*>|\[/[a-zA-Z]+\])*|\*{3}\s*|\[/size\]\s*)$""")
SEPARATOR = re.compile(r"^\s*(?:-{2,}|_{3,}|\*{3,}|<hr\s*/?>|\[size|={3,}|~{3,})", re.M)
NUMBER, DIGIT = re.compile(r"[0-9]+[.,][0-9]+"), re.compile("[0-9]")
TOKEN = re.compile(r"[^\W_]+(?:[._'’-][^\W_]+)*|[.!?…]+|\n\s*\n|\n")
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|\[/?[a-zA-Z*]+(?:=[^\[\]]{0,200})?\]")
STOPS = ".|…"
BLANK = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
TAIL = 400  # characters of a text that its ending is judged by
MOST = 4  # words of an ending that are looked up
RARE = 1_000  # times that a word is seen for each time that the beginning of it, if it is no word itself, stands alone
KNOWN = 5  # times that a word is seen to be known; weight of an ending's shorter form beside the longer


def measures(c: Column) -> dict[str, Column]:
    """The length of a text under each encoding, escaping and newline conversion."""

    def count(of: str) -> Column:
        return F.length(c) - F.length(F.translate(c, of, ""))

    def matching(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern))

    chars, octets = F.length(c), F.octet_length(c)
    ascii_only = chars == octets
    wide = F.when(ascii_only, 0).otherwise(matching(r"[^\x00-\x7F]"))
    astral = F.when(ascii_only, 0).otherwise(matching(r"[\x{10000}-\x{10FFFF}]"))
    words = F.when(ascii_only, matching(r"\S+")).otherwise(matching(r"(?U)\S+"))
    text = 4 * count("&") + 3 * count("<>")
    json = count('"\\\n\r\t\b\f') + 5 * count("".join(chr(i) for i in range(1, 32) if chr(i) not in "\n\r\t\b\f"))
    return {
        "chars": chars, "utf8": octets, "utf16": chars + astral, "html": chars + text + 5 * count("\"'"), "html_utf8": octets + text, "html_text": chars + text,
        "json": chars + json + 5 * wide + 6 * astral, "json_utf8": octets + json, "words": words, "crlf": chars + count("\n"), "crlf_utf8": octets + count("\n"),
    }


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers as #, names with digits as @, sentence ends as '.', paragraph ends as '|', trailing dots as '…'."""
    out: list[str] = []
    for t in TOKEN.findall(TAG.sub(lambda m: "\n\n" if m[0][:2].lower() in ("<p", "<b", "<h") or m[0][:3].lower() == "</p" else " ", text).lower()):
        if t.isalpha():
            out.append(t)
        elif t[0] in ".!?…":
            if not out or out[-1] not in STOPS:
                out.append("…" if "…" in t or ".." in t else ".")
        elif "\n" in t:
            if t.count("\n") > 1 and (not out or out[-1] not in STOPS):
                out.append("|")
        else:
            out.append("#" if t.isdigit() or NUMBER.fullmatch(t) else "@" if DIGIT.search(t) else t)
    return out


def ending(bare: str) -> dict:
    """How a text ends (its last part, without what is blank at its end, or dots put there): closed by a mark or a signature, and its last words."""
    signed = bool(SEPARATOR.search("\n".join(bare.split("\n")[-3:]))) if bare else False
    last: list[str] = []
    for t in reversed(tokens(bare)):
        if t in STOPS or len(last) == MOST:
            break
        last.insert(0, t)
    return {"closed": bool(CLOSED.search(bare)) if bare else True, "signed": signed, "comma": bare.endswith(","), "ended": bool(ENDED.search(bare)), "last": last, "token": re.split(r"\s", bare)[-1] if bare else ""}


def endings(docs: DataFrame) -> DataFrame:
    """Lengths and endings of (id, source, author, text); only the last part of a text is handed to Python."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for a, t in zip(pdf["author"], pdf["tail"], strict=True):
                e = ending(t)
                half = bool(isinstance(a, str) and 3 <= len(e["token"]) < len(a) and a.startswith(e["token"]) and re.search("[0-9._]", e["token"]))
                rows.append((e["closed"], e["signed"], e["comma"], e["ended"], e["last"], half))
            seen = pd.DataFrame(rows, columns=["closed", "signed", "comma", "ended", "last", "half"], index=pdf.index)
            yield pd.concat([pdf[["id", "source", "lengths", "dots", "text_end"]], seen], axis=1)

    # only the last part of a text is looked at for dots
    bare = F.rtrim("text", F.lit(BLANK))
    shown = F.expr("right(bare, 60)")
    d = docs.withColumn("bare", bare).withColumn("dots", F.regexp_like(shown, F.lit(DOTS)))
    whole = F.concat(F.expr("left(bare, greatest(length(bare) - 60, 0))"), F.regexp_replace(shown, DOTS, ""))
    d = d.withColumn("core", F.when(F.col("dots"), whole).otherwise(F.col("text")))
    d = d.withColumn("tail", F.expr(f"right(core, {2 * TAIL})")).withColumn("tail", F.rtrim("tail", F.lit(BLANK)))
    d = d.select(
        "id", "source", "author", "dots", F.expr(f"right(tail, {TAIL})").alias("tail"), F.array(*[v.cast("int") for v in measures(F.col("core")).values()]).alias("lengths"), F.xxhash64(F.expr("right(text, 200)")).alias("text_end"),
    )
    return d.mapInPandas(run, f"id {kind}, source string, lengths array<int>, dots boolean, text_end long, closed boolean, signed boolean, comma boolean, ended boolean, last array<string>, half boolean")


def word_counts(docs: DataFrame) -> DataFrame:
    """(gram, going, ending): how often up to MOST words were followed by more, and by the end of a sentence.

    The texts' own ends don't count, nor does what dots follow: cut texts and quotes of them have dots at the cut.
    """

    def run(batches):
        seen: Counter[tuple] = Counter()

        def flush():
            rows = [(" ".join(k[:-1]), 0 if k[-1] else n, n if k[-1] else 0) for k, n in seen.items() if k[-1] is not None and not any(t in STOPS for t in k[:-1])]
            seen.clear()
            return pd.DataFrame(rows, columns=["gram", "going", "ending"])

        for pdf in batches:
            for t in pdf["text"]:
                w = tokens(t)
                follows = [None if x == "…" else x in ".|" for x in w]
                for n in range(1, MOST + 1):
                    seen.update(zip(*[w[i:] for i in range(n)], follows[n:], strict=False))
            if len(seen) > 400_000:
                yield flush()
        yield flush()

    return docs.select("text").mapInPandas(run, "gram string, going long, ending long").groupBy("gram").agg(F.sum("going").alias("going"), F.sum("ending").alias("ending"))


def limits(ends: DataFrame, least: int = 4, of: int = 200, times: float = 6.0, open_share: float = 0.7) -> DataFrame:
    """(source, measure, length, n): lengths at which a source cuts.

    Such a length is had by ``least`` texts or more and by one in ``of`` of the source, ``times`` as many as its
    neighbours have on average, at least ``open_share`` of them without an end; of the measures that show it,
    those that show it best.  Texts that end alike, as copies do, count once.
    """
    names = list(measures(F.lit("")))
    by = F.map_from_arrays(F.array(*[F.lit(m) for m in names]), "lengths")
    # of texts that end alike, the shortest; its lengths decide
    ends = ends.groupBy("source", "text_end").agg(F.min_by(F.struct("closed", "signed", "lengths"), F.struct("lengths", "closed", "signed")).alias("e")).select("source", "e.*")
    sizes = ends.groupBy("source").agg((F.count("*") / of).alias("floor"))
    lengths = ends.select("source", (F.col("closed") | F.col("signed")).alias("shut"), F.explode(by).alias("measure", "length")).where("length >= 100")
    n = lengths.groupBy("source", "measure", "length").agg(F.count("*").alias("n"), F.sum(F.when(F.col("shut"), 0).otherwise(1)).alias("open"))
    near = W.partitionBy("source", "measure").orderBy("length").rangeBetween(-12, 12)
    n = n.withColumn("around", (F.sum("n").over(near) - F.col("n")) / 24)
    n = n.join(sizes, "source")
    spikes = n.where((F.col("n") >= least) & (F.col("n") >= F.col("floor")) & (F.col("n") >= times * F.col("around")) & (F.col("open") >= open_share * F.col("n")))
    return spikes.withColumn("best", F.max("n").over(W.partitionBy("source"))).where("n * 2 >= best").select("source", "measure", "length", "n")


def truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", author: str = "author", share: float = 0.02) -> DataFrame:
    """(doc_id, source, reason) of the texts that were cut; ``reason`` is 'limit', 'word' or 'sentence'.

    'limit': the text has a length at which its source cuts, and doesn't end there; dots put at the cut don't
    hide it.  'word': the last word isn't one, or hardly ever beside a word that it begins.  'sentence': after the same last words fewer than
    ``share`` of the sentences end, the longer endings smoothed by the shorter, or it stops at a comma.  A text that carelessly lacks its
    last mark, is signed, or trails off in dots away from any limit isn't cut.  Null and empty texts and null ids
    aren't cases; a null source is a source of its own; each row is judged by its own text.
    """
    own = docs.where(F.col(doc_id).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(doc_id).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(author).alias("author"), F.col(text).alias("text"))
    ends = checkpointed(endings(own))
    at = checkpointed(limits(ends))
    open_ends = ends.where(~F.col("closed"))
    slack = F.when(F.col("measure").isin(*BYTES), 3).otherwise(0)
    by = F.map_from_arrays(F.array(*[F.lit(m) for m in measures(F.lit(""))]), "lengths")
    sized = ends.where(~F.col("ended")).join(at.select("source").distinct(), "source", "left_semi").select("id", "source", F.explode(by).alias("measure", "size"))
    cut = sized.join(at, ["source", "measure"]).where((F.col("size") <= F.col("length")) & (F.col("size") >= F.col("length") - slack)).select("id").distinct()
    judged = open_ends.where(~F.col("dots") & (F.size("last") > 0))
    counts = checkpointed(word_counts(own))
    word = F.element_at("last", -1)
    grams = F.transform(F.sequence(F.lit(1), F.size("last")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("last", F.size("last") - n + 1, n), " ").alias("gram")))
    suffix = judged.select("id", "signed", "half", "comma", word.alias("word"), F.explode(grams).alias("g")).select("id", "signed", "half", "comma", "word", "g.n", "g.gram")
    # how often whole texts end on the same two words: closings and mottos are ends, though no mark follows
    docs_n = ends.count()
    usual = suffix.where("n = 2").groupBy("gram").count().where(F.col("count") >= max(5, docs_n // 2000)).select("gram", F.lit(True).alias("usual"))
    seen = suffix.join(counts, "gram", "left").join(usual, "gram", "left").fillna(0, ["going", "ending"])
    ended = F.aggregate(
        F.array_sort(F.collect_list(F.struct("n", "going", "ending"))), F.lit(0.1), lambda p, x: (x["ending"] + KNOWN * p) / (x["going"] + x["ending"] + KNOWN)
    )
    judge = seen.groupBy("id").agg(
        F.max("signed").alias("signed"), F.max("half").alias("half"), F.max("word").alias("word"), F.max(F.coalesce("usual", F.lit(False))).alias("usual"),
        F.max(F.when(F.col("n") == 1, F.col("going") + F.col("ending"))).alias("times"),
        ended.alias("ended"), F.max("comma").alias("comma"),
    )
    vocabulary = counts.where((F.instr("gram", " ") == 0) & (F.col("going") + F.col("ending") >= KNOWN) & (F.length("gram") > 1)).select("gram", (F.col("going") + F.col("ending")).alias("whole"))
    stems = vocabulary.select("whole", F.explode(F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda k: F.substring("gram", F.lit(1), k))).alias("word")).groupBy("word").agg(F.max("whole").alias("whole"))
    judge = judge.join(stems, "word", "left")
    # however large the corpus: quotes of cut texts make each beginning seen, but rarely beside its word
    half_word = F.coalesce((F.col("times") < 3) | (F.col("times") * RARE < F.col("whole")), F.lit(False)) & F.col("whole").isNotNull()
    unended = (F.col("ended") < share) | F.col("comma")
    why = F.when(F.col("half"), "word").when(F.col("signed") | F.col("usual"), None).when(half_word, "word").when(unended, "sentence")
    inside = judge.withColumn("reason", why).where("reason IS NOT NULL").select("id", "reason")
    all_of = cut.withColumn("reason", F.lit("limit")).unionByName(inside).groupBy("id").agg(F.min("reason").alias("reason"))
    return all_of.join(ends.select("id", "source"), "id").select(F.col("id").alias(doc_id), F.nullif("source", F.lit("")).alias("source"), "reason")


def truncation_rates(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, docs, cut, rate): how often each source truncates, over its non-empty texts."""
    held = docs.where(F.col(doc_id).isNotNull() & (F.length(F.trim(text)) > 0)).select(doc_id, source)
    flag = found.select(doc_id, F.lit(1).alias("hit")).distinct()
    return held.join(flag, doc_id, "left").groupBy(source).agg(F.count("*").alias("docs"), F.count("hit").alias("cut")).withColumn("rate", F.round(F.col("cut") / F.col("docs"), 6))
