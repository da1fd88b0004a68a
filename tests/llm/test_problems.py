"""The numbered problems on small fixtures: brute force, round trips, nulls, ties, repeats, empty tables, clashing names."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import components, ids, names, p1_linkage, p2_canonical, p3_splits, p4_knn, p5_topn, p6_overlap, p7_packing, p8_leaks, p9_truncation, queries

SF = "/root/testdata/sf0.01"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---------------------------------------------------------------- names and ids


def test_edits_is_levenshtein():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in "ab")
        assert names.edits(a, b) == plain(a, b)


def test_slips_count_changed_places_once():
    def plain(a, b):
        before, last = None, list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
                if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, before[j - 2] + 1)
                row.append(best)
            before, last = last, row
        return last[-1]

    r = random.Random(11)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in "ab")
        assert names.slips(a, b) == plain(a, b)


def test_bk_tree_finds_all_within():
    r = random.Random(2)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(3, 8))) for _ in range(200)]
    tree = names.BKTree(words)
    for q in words[:20] + ["", "zzzz"]:
        assert {w for _, w in tree.within(q, 2)} == {w for w in words if names.edits(q, w) <= 2}


@pytest.mark.parametrize(
    ("typed", "kind", "name", "codes"),
    [
        ("Rispov-astutataxel", "name", "rispovastutataxel", []),
        ("drug: rispovastutataxel (HCl)", "name", "rispovastutataxel", []),
        ("OR–272984", "code", "", ["or-272984-"]),
        ("GN-4272247-OH", "code", "", ["gn-4272247-oh"]),
        ("DMSO", "nothing", "", []),
        ("Aabbccdd + eeffgghh", "mixture", "", []),
        ("", "nothing", "", []),
    ],
)
def test_substance(typed, kind, name, codes):
    s = names.substance(typed)
    assert (s["kind"], s["name"], s["codes"]) == (kind, name, codes)


def test_canonical_ids(spark):
    df = spark.createDataFrame([("onx00000001_tumor",), (" ONX-00000001 ",), ("ONX00000001_T2",), (None,), ("  ",)], "x string")
    assert [r[0] for r in df.select(ids.canonical_patient(F.col("x"))).collect()] == ["ONX00000001", "ONX00000001", "ONX00000001_T2", None, None]
    donors = spark.createDataFrame([("dn_00095028 ",), ("DN-00095028",), ("DN-00000000",), ("n/a",), (None,)], "x string")
    assert [r[0] for r in donors.select(ids.canonical_donor(F.col("x"))).collect()] == ["DN-95028", "DN-95028", None, None, None]


# ---------------------------------------------------------------- 1


ASSAY = "assay_id string, sample_id string, drug_id string, drug_name string, inchikey string, drugbank_id string, pubchem_cid long, k int"
XREF = "xref_id long, input_name string, source string, notes string, inchikey string, drugbank_id string, pubchem_cid long, k int"


def test_linkage(spark):
    words = ["rispovastutataxel", "trerastidosadegib", "gokubonipamycin", "zubrujitruglomycin", "tizatrothuspuparib", "xabogluvestimycin"]
    assays, xref = [], []
    for i, w in enumerate(words):
        for j in range(3):
            assays.append((f"A{i}{j}", "S", f"D{i}", w, None, None, 900 + i, 1))
        assays.append((f"A{i}9", "S", f"D{i}", w[:5] + w[6:], None, None, None, 1))
        xref.append((i, w.upper(), "a", None, None, None, 900 + i if i % 2 else None, 1))
        xref.append((100 + i, w[:6] + w[7] + w[6] + w[8:], "b", None, None, None, 900 + i, 1))
    xref += [(50, "des" + words[0], "a", None, None, None, None, 1), (51, None, "a", None, None, None, None, 1), (None, "x", None, None, None, None, None, 1)]
    assays += [("C1", "S", "CTRL", "DMSO", None, None, 900, 1), ("M1", "S", "MIX", f"{words[0]} + {words[1]}", None, None, 900, 1), (None, None, None, None, None, None, None, 1)]
    got = p1_linkage.linked(spark.createDataFrame(assays + assays[:3], ASSAY), spark.createDataFrame(xref + xref[:2], XREF)).where("confidence >= 0.5")
    assert rows(got, "drug_id", "xref_id") == sorted([(f"D{i}", k) for i in range(len(words)) for k in (i, 100 + i)])
    none = spark.createDataFrame([], XREF)
    assert p1_linkage.linked(spark.createDataFrame(assays, ASSAY), none).count() == 0


def test_deletions_meet_within_two_slips():
    r = random.Random(4)
    for _ in range(200):
        a = "".join(r.choice("abcdef") for _ in range(8))
        b = list(a)
        for _ in range(2):
            i = r.randrange(len(b) - 1)
            op = r.randrange(4)
            if op == 0:
                b[i] = r.choice("abcdef")
            elif op == 1:
                del b[i]
            elif op == 2:
                b.insert(i, r.choice("abcdef"))
            else:
                b[i], b[i + 1] = b[i + 1], b[i]
        assert p1_linkage.left_out(a) & p1_linkage.left_out("".join(b))


def test_long_names_meet_within_two_slips_by_few_keys():
    r = random.Random(5)
    for _ in range(400):
        a = "".join(r.choice("abcdef") for _ in range(r.randint(20, 60)))
        b = list(a)
        for _ in range(2):
            i, op = r.randrange(len(b) - 1), r.randrange(4)
            if op == 0:
                b[i] = r.choice("abcdef")
            elif op == 1:
                del b[i]
            elif op == 2:
                b.insert(i, r.choice("abcdef"))
            else:
                b[i], b[i + 1] = b[i + 1], b[i]
        assert p1_linkage.name_forms(a, False) & p1_linkage.name_forms("".join(b), True)
    assert len(p1_linkage.name_forms("x" * 1000, True)) <= 125


def test_confidence_is_calibrated():
    """Of pairs given a confidence near p, about the share p are true, for voters of different worth."""
    r = np.random.default_rng(1)
    y = r.random(20000) < 0.3
    v = np.stack([np.where(r.random(20000) < 0.3, 0, np.where(r.random(20000) < a, y, ~y) * 2 - 1) for a in (0.9, 0.85, 0.8, 0.7, 0.75)], 1)
    ways, at, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    q = p1_linkage.LabelModel(ways, n).q[at.ravel()]
    bins = np.minimum((q * 5).astype(int), 4)
    assert sum((bins == b).mean() * abs(y[bins == b].mean() - q[bins == b].mean()) for b in range(5) if (bins == b).any()) < 0.05


def test_label_model_learns_a_bad_voter():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.5
    good = np.stack([np.where(r.random(4000) < 0.9, y, ~y) for _ in range(4)], 1) * 2 - 1
    bad = (r.random((4000, 1)) < 0.5) * 2 - 1
    v, n = np.unique(np.hstack([good, bad]), axis=0, return_counts=True)
    model = p1_linkage.LabelModel(v, n)
    confident = {tuple(p): q for p, q in zip(v, model.q, strict=True)}
    assert confident[1, 1, 1, 1, -1] > 0.95 and confident[-1, -1, -1, -1, 1] < 0.05


# ---------------------------------------------------------------- 2


TERMS = [("T4", "subtype", "biphasic osteosarcoma", None), ("T5", "subtype", "sclerosing fibrosarcoma", None), ("T1", "subtype", "myxoid fibrosarcoma", "MFIB"), ("T2", "subtype", "biphasic liposarcoma", None), ("T3", "subtype", "myxoid liposarcoma", None), ("D1", "drug_name", "Rispovastutataxel", "SYQ-468070")]


def test_canonical_values(spark):
    terms = spark.createDataFrame(TERMS + TERMS[:1], "term_id string, field_name string, term_name string, synonyms string")
    asked = {
        "subtype": {"Myxoid Fibrosarcoma": "T1", "mfib": "T1", "liposarcoma (biphasic)": "T2", "biphasic fibrosarcoma": "none", "liposarcoma": "none", "myxiod lipsarcoma": "T3", "x": "none"},
        "drug_name": {"rispovastutataksel": "D1", "syq 468070": "D1", "SYQ-468071": "none", "Desrispovastutataxel": "none", "Rispovastutataxel + Gokubonipamycin": "none", "rispovstuatataxel 10 uM": "D1"},
    }
    records = [(f, f"{f}{i}", v) for f, x in asked.items() for i, v in enumerate(x)] + [("subtype", "blank", " "), ("subtype", "null", None), ("subtype", "exact", "myxoid fibrosarcoma"), ("subtype", None, "x")]
    got = p2_canonical.mapped_records(spark.createDataFrame(records + records[:2], "field string, record_id string, value string").withColumn("term_name", F.lit("clash")), terms)
    assert rows(got, "field_name", "record_id", "term_id") == sorted((f, f"{f}{i}", t) for f, x in asked.items() for i, t in enumerate(x.values()))
    none = p2_canonical.mapped_values(spark.createDataFrame([("subtype", "y")], "field string, value string"), terms.limit(0))
    assert rows(none, "field", "value", "term_id") == [("subtype", "y", "none")]
    assert p2_canonical.mapped_values(spark.createDataFrame([], "field string, value string"), terms).count() == 0


def test_sharded_list_gives_the_same(spark, monkeypatch):
    terms = spark.createDataFrame(TERMS, "term_id string, field_name string, term_name string, synonyms string")
    values = spark.createDataFrame([("drug_name", "rispovastutataksel"), ("subtype", "liposarcoma (biphasic)")], "field string, value string")
    whole = rows(p2_canonical.mapped_values(values, terms), "field", "value", "term_id")
    monkeypatch.setattr(p2_canonical, "SHARD_ENTRIES", 2)
    monkeypatch.setattr(p2_canonical, "BLOCK_FORMS", 1)
    assert rows(p2_canonical.mapped_values(values, terms), "field", "value", "term_id") == whole


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_small_shards_change_no_answer(spark, monkeypatch):
    whole = set(rows(queries.p2_found(spark, SF), "field_name", "record_id", "term_id"))
    monkeypatch.setattr(p2_canonical, "SHARD_ENTRIES", 50)
    assert set(rows(queries.p2_found(spark, SF), "field_name", "record_id", "term_id")) == whole and ("subtype", "ONX00000181", "none") in whole
    listed = {tuple(r)[:2]: r["records"] for r in queries.p2_unmatched(spark, SF).collect()}
    assert sum(listed.values()) == sum(t == "none" for *_, t in whole)


# ---------------------------------------------------------------- 3


def test_components_by_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(30)] + [(0, i) for i in range(300, 340)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        top[max(find(a), find(b))] = min(find(a), find(b))
    got = components.components(spark.createDataFrame([*edges, (None, 1), (5, 5)], "a long, b long"))
    assert rows(got, "node", "root") == sorted((x, find(x)) for x in top if find(x) != x)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_keeps_groups_and_shares(spark):
    r = random.Random(5)
    records = [(f"r{i}", f"g{r.randrange(500)}" if i % 3 else None, r.choice(["a", "b", "b", "c", None])) for i in range(3000)]
    records += [(f"h{i}", "giant", "a") for i in range(1000)] + [(None, "g1", "a")]
    plan = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1), (None, 0.5), ("zero", 0.0)], "split_label string, target_share double")
    df = spark.createDataFrame(records + records[:50], "record string, `group` string, label string").withColumn("split_label", F.lit("clash"))
    got = p3_splits.grouped_stratified_split(df, plan).collect()
    assert len(got) == 4000
    of = {}
    for x in got:
        of.setdefault(x["group"], set()).add(x["split"])
    assert all(len(s) == 1 for s in of.values())
    for label in ("a", "b", "c", None):
        n = [x["split"] for x in got if x["label"] == label]
        assert abs(n.count("train") / len(n) - 0.8) < 0.05
    assert p3_splits.grouped_stratified_split(df.limit(0), plan).count() == 0


def test_patient_groups_ignore_placeholders_and_strangers(spark):
    p = spark.createDataFrame(
        [("P1", {"donor": "DN-1"}), ("P2", {"donor": "dn 01", "related_to": "p3_tumor"}), ("P3", {"donor": "n/a"}), ("P4", {"donor": "n/a"}), ("P5", {"related_to": "P99"}), ("P6", None), (None, {"donor": "DN-1"})],
        "patient_id string, metadata map<string,string>",
    )
    assert rows(p3_splits.patient_groups(p.union(p)), "group_first", "patient_id") == [("P1", "P2"), ("P1", "P3")]


# ---------------------------------------------------------------- 4


def test_knn_recall(spark, monkeypatch):
    r = np.random.default_rng(6)
    centre = r.normal(size=(30, 32))
    x = (centre[r.integers(0, 30, 600)] + 0.3 * r.normal(size=(600, 32))).astype(np.float32)
    x[100:160] = x[100]  # a group of copies
    x[200:210] = x[201] * np.arange(1, 11)[:, None]
    data = [(f"s{i:04d}", v.tolist(), "clash") for i, v in enumerate(x)]
    bad = [("n1", None, ""), ("n2", [0.0] * 32, ""), ("n3", [1.0] * 31, ""), ("n4", [float("nan")] * 32, ""), ("n5", [None] * 32, ""), (None, x[0].tolist(), "")]
    df = spark.createDataFrame(data + data[:20] + bad, "key string, v array<float>, other string")
    u = p4_knn.unit(x)
    want = set()
    for i in range(len(x)):
        s = np.round(u @ u[i], 6)
        s[i] = -9
        for j in np.argsort(-s, kind="stable")[:5]:
            if s[j] >= 0.8:
                want.add((f"s{i:04d}", f"s{j:04d}"))
    exact = set(rows(p4_knn.most_similar(df, "key", "v", 32, nprobe=None), "key", "other"))
    assert exact == want
    got = set(rows(p4_knn.most_similar(df, "key", "v", 32, nprobe=8), "key", "other"))
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95
    monkeypatch.setattr(p4_knn, "BLOCK_ROWS", 7)  # long lists in blocks, and queries of a list in parts
    monkeypatch.setattr(p4_knn, "BLOCK_ASKED", 5)
    monkeypatch.setattr(p4_knn, "MAX_COARSE", 4)  # and lists divided by centroids of residuals
    assert set(rows(p4_knn.most_similar(df, "key", "v", 32, nprobe=None), "key", "other")) == want
    assert p4_knn.most_similar(df.where("key IS NULL"), "key", "v", 32).count() == 0


# ---------------------------------------------------------------- 5


def test_top_n(spark):
    r = random.Random(7)
    data = [("hot" if r.random() < 0.4 else f"g{r.randrange(20)}", f"i{r.randrange(40)}", r.choice([0.1, 0.2, 0.3, r.random()])) for _ in range(3000)]
    odd = [("g1", "nan", float("nan")), ("g1", "inf", float("inf")), ("g1", None, 9.0), (None, "i1", 9.0), ("g1", "null", None), ("only", "bad", None)]
    df = spark.createDataFrame(data + odd + data[:100], "grp string, item string, score double").withColumn("rank", F.lit("clash")).withColumn("g", F.lit(1))
    best = {}
    for g, i, s in data:
        best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -1))
    want = sorted((g, i, k + 1) for g, x in best.items() for k, (i, s) in enumerate(sorted(x.items(), key=lambda t: (-t[1], t[0]))[:4]))
    assert rows(p5_topn.top_n(df, "grp", "item", "score", 4), "grp", "item", "rank") == want
    assert p5_topn.top_n(df.limit(0), "grp", "item", "score", 4).count() == 0


# ---------------------------------------------------------------- 6


def test_overlaps(spark):
    note = "resection margin clear, plug 46 kept, slow growth, edge piece"
    samples = [
        ("S1", "P1", "t", 1, 0, {"block": "A12-3456", "cells_k": "10.5", "viab_pct": "80.0", "collected_on": "2020-01-02", "note": note, "site": "s1"}),
        ("S2", "P2", "t", None, 0, {"block": "a12 3456", "cells_k": "10.5", "viab_pct": "80%", "collected_on": "02.01.2020", "note": note.upper(), "site": "s1"}),
        ("S3", "P3", "t", 1, 0, {"block": "F99-1111", "cells_k": "77.1", "viab_pct": "41.0", "collected_on": "2021-05-05", "note": note, "site": "s2"}),
        ("S4", None, "t", 1, 0, {"block": "A12-3456"}), ("S5", "P4", None, None, None, None),
    ]
    s = spark.createDataFrame(samples + samples[:1], "sample_id string, patient_id string, tranche_id string, passage int, replicate int, metadata map<string,string>")
    patients = spark.createDataFrame([(p, "t") for p in ("P1", "P2", "P3", "P4", "P1_T2")] + [(None, None)], "patient_id string, tranche_id string")
    folds = spark.createDataFrame([("f1", "x", ["p2", "P1_T2", None, "P9"], ["P1", "P1", "P3"]), ("f2", "x", ["P3"], ["P3_Tumor", "P9"]), ("f3", "x", None, ["P1"]), (None, "x", ["P1"], ["P1"])], "fold_id string, split_name string, train_patient_ids array<string>, test_patient_ids array<string>")
    got = p6_overlap.overlaps(folds, patients, s)
    assert rows(got, "fold_id", "patient_a", "patient_b", "how") == [("f1", "P1", "p2", "record"), ("f2", "P3", "P3_Tumor", "id")]
    assert rows(p6_overlap.overlap_counts(got, folds, patients), "split_name", "tranche_id", "pairs") == [("x", "t", 2)]
    assert p6_overlap.overlaps(folds.limit(0), patients, s.limit(0)).count() == 0


def made_records(spark, n=40):
    """Specimens registered five times each, with slips, other numbers and missing fields."""
    r, stock = random.Random(7), ["resection", "margin", "clear", "plug", "kept", "slow", "edge", "piece", "frozen", "rim"]
    samples = []
    for i in range(n):
        base = (f"{r.choice('AB')}{r.randint(0, 9999):04d}", r.choice([3.0, 9.0, 55.0, 300.0]) * (1 + r.random()), r.uniform(40, 99), r.randint(1, 28), r.sample(stock, 6))
        for j in range(5):
            block = list(base[0])
            if r.random() < 0.1:
                block[r.randrange(5)] = "7"
            m = {"block": "".join(block), "cells_k": f"{base[1] * r.choice([1] * 20 + [0.94, 1.07]):.2f}", "viab_pct": f"{base[2] + r.choice([0] * 20 + [2.4, -2.5]):.1f}", "collected_on": f"2020-{r.choice('11111111113')}-{base[3]:d}", "note": " ".join(base[4][: r.randint(4, 6)]), "site": r.choice(["s1", "s1", "s2"])}
            for f in r.sample(sorted(m), r.randint(0, 1)):
                del m[f]
            samples.append((f"S{i}{j}", f"P{i * 10 + j}", r.choice(["t", "u"]), r.choice([None, 1, 2]), r.choice([None, 0]), m))
    s = spark.createDataFrame(samples, "sample_id string, patient_id string, tranche_id string, passage int, replicate int, metadata map<string,string>")
    return p6_overlap.specimen_records(s).withColumn("id", F.col("class")).cache()


def test_near_records_are_those_of_all_pairs(spark):
    """Every pair that agrees in enough segments and isn't too far apart is met, in whatever tranche and with whatever fields missing."""
    from itertools import combinations

    records = made_records(spark)
    prints = {r["id"]: r.asDict() for r in p6_overlap.fingerprints(records).collect()}
    assert len({r[n] for r in prints.values() for n in p6_overlap.NOTE}) > 8  # the four note hashes are different ones

    def meets(x, y):
        return any(all(x[s] is not None and x[s] == y[s] for s in b) for b in p6_overlap.BLOCKS)

    def apart(x, y):
        both = [s for s in p6_overlap.SEGMENTS if x[s] is not None and y[s] is not None]
        return 128 * sum((x[s] ^ y[s]).bit_count() for s in both) / sum(16 if s in p6_overlap.MEASURED else 12 for s in both)

    want = {(x, y) for x, y in combinations(sorted(prints), 2) if meets(prints[x], prints[y]) and apart(prints[x], prints[y]) <= p6_overlap.RADIUS}
    got = set(rows(p6_overlap.candidates(records), "x", "y"))
    assert got == want and len(want) > 30
    near = records.alias("a").join(records.alias("b"), F.col("a.id") < F.col("b.id")).where(p6_overlap.verified()).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.col("a.tranche").alias("s"), F.col("b.tranche").alias("t"))
    near = rows(near, "x", "y", "s", "t")
    found = set(rows(p6_overlap.near_classes(records.drop("id")).where("x < y"), "x", "y"))
    assert found == {w[:2] for w in near} & want
    assert len(found) >= 0.9 * len(near) and sum(s != t for *_, s, t in near) >= 20


def test_hot_blocks_of_codes_are_divided(spark, monkeypatch):
    monkeypatch.setattr(p6_overlap, "HOT", 8)
    one = {"viab_pct": "0.0", "collected_on": "2000-01-01", "note": "viable rim core biopsy"}  # what a third of all records have
    samples = [(f"S{i}", f"P{i}", "t", None, None, one | {"cells_k": str(10 + 3 * i), "block": f"A{i:03d}-{9999 - i * 7}"}) for i in range(60)]
    samples.append(("S99", "P99", "u", None, None, one | {"cells_k": "16", "block": "A002-9985"}))
    s = spark.createDataFrame(samples, "sample_id string, patient_id string, tranche_id string, passage int, replicate int, metadata map<string,string>")
    records = p6_overlap.specimen_records(s).withColumn("id", F.col("class")).cache()
    keys = p6_overlap.code_blocks(p6_overlap.fingerprints(records)).cache()
    assert keys.groupBy("k").count().agg(F.max("count")).first()[0] <= 8
    of = {r["canon"]: r["id"] for r in records.collect()}
    assert set(rows(p6_overlap.near_classes(records.drop("id")).where("x < y"), "x", "y")) == {tuple(sorted((of["P2"], of["P99"])))}


# ---------------------------------------------------------------- 7


def test_fill_never_overflows_and_is_tight():
    r = random.Random(8)
    for capacity in (7, 100, 512):
        sizes = [r.randint(1, capacity) if r.random() < 0.3 else r.randint(1, max(1, capacity // 5)) for _ in range(2000)]
        load = {}
        for s, c in zip(sizes, p7_packing.fill(sizes, capacity), strict=True):
            load[c] = load.get(c, 0) + s
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        large = sum(s * 2 > capacity for s in sizes)
        assert len(load) <= max(large, -(-sum(sizes) // capacity)) * 1.03 + 1
    assert p7_packing.fill([], 5) == []


def test_packing_round_trip(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 37)) for i in range(300)] + [(900, "long " * 3000), (901, ""), (902, None), (None, "x")], "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    counts = p7_packing.token_counts(docs, "doc_id", "text").cache()
    targets = spark.createDataFrame([(1, 64), (2, 512), (2, 512), (3, None), (4, 0)], "target_id long, capacity_tokens long")
    got = p7_packing.packed(counts, targets).cache()
    assert got.groupBy("target_id", "container_id").agg(F.sum("tokens").alias("t")).join(targets.distinct(), "target_id").where("t > capacity_tokens").count() == 0
    whole = got.groupBy("target_id", "doc").agg(F.sum("tokens").alias("t"), F.count("*").alias("k")).join(counts, "doc")
    assert whole.where("t <> tokens").count() == 0 and whole.where("target_id = 2 AND tokens <= 512 AND k > 1").count() == 0
    assert got.select("target_id").distinct().count() == 2
    assert p7_packing.packed(counts.limit(0), targets).count() == 0 and p7_packing.packed(counts, targets.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


def test_wu_manber_finds_every_window():
    r = random.Random(9)
    items = [(i, " ".join(r.choice("abcdefg") for _ in range(20))) for i in range(5)]
    table = p8_leaks.WuManber(items, 6)
    text = table.numbers(" ".join(r.choice("abcdefgh") for _ in range(300)) + " " + items[2][1] + " z " + items[4][1][:25])
    held = {i: table.words[table.starts[i] : table.starts[i + 1]].tolist() for i in range(5)}
    want = {(i, k, s) for i, w in held.items() for k in range(len(w) - 5) for s in range(len(text) - 5) if text[s : s + 6] == w[k : k + 6]}
    assert set(table.search(text)) == want and want


def test_leaks(spark, monkeypatch):
    item = "judging by two blinded scores half of the monoclonal pool keeps most of its migration speed while the scaffold remains glycolytic"
    w = item.split()
    one = [*w[2:8], "swapped", *w[9:14]]
    docs = [
        (1, "Quoted:\n> Judging by <b>two</b> blinded scores,\n> half of the m0noclonal pool&nbsp;keeps most of its migration\n> speed"), (2, " ".join(w[2:13])), (3, "x " + " ".join(one) + " y"),
        (4, " ".join([*w[:5], "a", *w[6:10], "b", *w[11:15]])), (5, None), (6, ""), (None, item), (7, "z " * 20000 + item.upper()), (8, " ".join([*w[:6], *w[7:13]])), (9, " ".join([*w[:6], "more", *w[6:11]])),
    ]
    d = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").withColumn("item", F.lit("clash"))
    items = spark.createDataFrame([(1, item), (1, item), (2, "too short"), (3, None), (None, item)], "item_id long, item_text string")
    assert rows(p8_leaks.leaks(d, items, "doc_id", "text", "item_id", "item_text"), "doc_id", "item_id") == [(1, 1), (3, 1), (7, 1)]
    other = items.union(spark.createDataFrame([(9, " ".join(reversed(w)))], "item_id long, item_text string"))
    monkeypatch.setattr(p8_leaks, "SHARD_WORDS", 5)  # a shard for nearly every item
    for size in (1 << 20, 1):  # in one pass, and in one for each shard
        monkeypatch.setattr(p8_leaks, "PASS_BYTES", size)
        assert rows(p8_leaks.leaks(d, other, "doc_id", "text", "item_id", "item_text"), "doc_id", "item_id") == [(1, 1), (3, 1), (7, 1)]
    assert p8_leaks.leaks(d, items.limit(0), "doc_id", "text", "item_id", "item_text").count() == 0
    assert p8_leaks.leaks(d.limit(0), items, "doc_id", "text", "item_id", "item_text").count() == 0


# ---------------------------------------------------------------- 9


def test_truncation(spark):
    r = random.Random(10)

    def post():
        return " ".join(f"The {r.choice(['shaker', 'reader', 'washout', 'incubator'])} was {r.choice(['noisy', 'stable', 'cloudy'])} after the {r.choice(['move', 'update', 'weekend'])}." for _ in range(r.randint(3, 12)))

    docs = [(i, "free", post()) for i in range(400)]
    for i in range(400, 700):
        t = post()
        docs.append((i, "tight", t[:180] if len(t) > 180 else t))
    cut = {i for i, s, t in docs if s == "tight" and len(t) == 180 and not t.endswith(".")}
    docs += [(1001, "free", post() + " The shaker was noisy after the"), (1002, "free", post() + " The incuba"), (1003, "free", post()[:-1]), (1004, "free", post() + ".."), (1005, "free", None), (1006, "free", " "), (1007, None, post())]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("author", F.lit(None).cast("string")).withColumn("length", F.lit("clash"))
    found = p9_truncation.truncated(df).cache()
    assert {x[0] for x in found.select("doc_id").collect()} == cut | {1001, 1002}
    rate = {x["source"]: x["cut"] for x in p9_truncation.truncation_rates(df, found).collect()}
    assert rate["tight"] == len(cut) and rate["free"] == 2
    assert p9_truncation.truncated(df.limit(0)).count() == 0


def test_beginnings_of_words_that_others_quote_stay_cut(spark):
    whole = "we put the plate on the desk and the lid on the rack near the door by the wall. " * 25
    texts = [whole] * 40 + ["all of it stood by th...\n\nwell. "] * 20 + ["> all of it stood by st\n\nwell. we stand by the rack and stay."] * 4
    texts += ["the stand was seen. " * 200] * 25 + ["we left it so th", "it was in the st"]
    docs = spark.createDataFrame([(i, t, "s", "a") for i, t in enumerate(texts)], "doc_id long, text string, source string, author string")
    found = {r["doc_id"]: r["reason"] for r in p9_truncation.truncated(docs).collect()}
    assert found.get(len(texts) - 2) == "word" and found.get(len(texts) - 1) == "word"
