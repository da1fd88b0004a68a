"""Measured, global and conditional deltas, id maps, merged means and row correlations against plain computations."""

import random

import numpy as np
import pytest

from panelwright.operators import deltas, metrics, relational

ROWS = "line string, drug string, is_control boolean, replicate long, feature string, value double"


def made_rows(seed=3, lines=8, features=("a", "b", "c", "d")):
    r = random.Random(seed)
    out = []
    for i in range(lines):
        for drug in ("ctl", "x", "y"):
            for rep in range(2):
                out += [(f"l{i}", drug, drug == "ctl", rep, f, r.random() * 4) for f in features]
    return out


def mean_by(rows, *at):
    g = {}
    for r in rows:
        g.setdefault(tuple(r[i] for i in at), []).append(r[5])
    return {k: sum(v) / len(v) for k, v in g.items()}


def test_conditional_deltas_are_the_ridge_on_components(spark):
    rows, names = made_rows(), ["a", "b", "c", "d"]
    r = random.Random(4)
    base = [(f"o{i}", f, r.random() * 90) for i in range(6) for f in names]
    asked = [(f"o{i}", d) for i in range(6) for d in ("x", "y")]
    got = deltas.conditional_deltas(spark.createDataFrame(rows, ROWS), spark.createDataFrame(base, "line string, feature string, value double"), spark.createDataFrame(asked, "line string, drug string"), names, 2)
    got = {(x["line"], x["drug"], x["feature"]): x["value"] for x in got.collect()}
    m = mean_by(rows, 0, 1, 4)
    lines = [f"l{i}" for i in range(8)]
    c = np.array([[m[ln, "ctl", f] for f in names] for ln in lines])
    sd = c.std(0)
    z = (c - c.mean(0)) / sd
    v = np.linalg.svd(z - z.mean(0))[2][:2].T
    b = np.array([[x for o, _, x in base if o == f"o{i}"] for i in range(6)])
    zb = (b - b.mean(0)) / b.std(0)
    for d in ("x", "y"):
        y = (np.array([[m[ln, d, f] for f in names] for ln in lines]) - c) / sd
        x = z @ v
        w = np.linalg.solve(x.T @ x + np.eye(2), x.T @ (y - y.mean(0)))  # components have mean 0
        want = zb @ v @ w
        for i in range(6):
            for j, f in enumerate(names):
                assert got[f"o{i}", d, f] == pytest.approx(want[i, j], abs=1e-8)


def test_conditional_deltas_need_lines(spark):
    rows = spark.createDataFrame(made_rows(lines=2), ROWS)
    base = spark.createDataFrame([("o", "a", 1.0)], "line string, feature string, value double")
    assert deltas.conditional_deltas(rows, base, spark.createDataFrame([("o", "x")], "line string, drug string"), ["a", "b", "c", "d"], 1).count() == 0


def test_measured_pairs_cap_replicates_and_name_features(spark):
    rows = [("l", "x", False, i, "f1", float(i)) for i in (9, 2, 5)] + [("l", "ctl", True, 1, "f1", 1.0), ("l", "x", False, 2, "f2", 7.0), ("l", "ctl", True, 1, "f2", 2.0), ("l", "x", False, 2, "f3", 7.0), ("m", "x", False, 1, "f1", 4.0)]
    symbols = spark.createDataFrame([("f1", "A"), ("f2", "A"), ("f3", ""), ("f4", None)], "feature string, symbol string")
    got = deltas.measured_pairs(spark.createDataFrame(rows, ROWS), symbols, 2).collect()
    assert [tuple(x) for x in got] == [("l", "x", "A", 3.5 - 1.0)]  # 9 is the third replicate, f2 repeats A, m has no control


def test_global_and_filled(spark):
    rows = spark.createDataFrame([("l", "x", False, 1, "f", 4.0), ("m", "x", False, 1, "f", 6.0), ("m", "c", True, 1, "f", 1.0), ("m", "x", False, 1, "g", 3.0)], ROWS)
    assert [tuple(x) for x in deltas.global_deltas(rows).collect()] == [("x", "f", 4.0)]
    filled = deltas.filled_by_drug(rows.where("NOT is_control")).collect()
    assert {(x["line"], x["feature"], x["value"]) for x in filled} == {("l", "f", 4.0), ("l", "g", 0.0), ("m", "f", 6.0), ("m", "g", 3.0)}


def test_stems_and_picked_column(spark):
    kind = "name string, id long"
    ids = spark.createDataFrame([("one", 4), ("one", 3), ("two words", 5), (None, 9)], kind)
    further = spark.createDataFrame([("k3", 6), ("one", 1)], kind)
    stems = spark.createDataFrame([("one",), ("two_words",), ("k3",), ("two",), ("one",)], "stem string")
    assert {tuple(x) for x in relational.resolved_stems(stems, ids, further).collect()} == {("one", 3), ("two_words", 5), ("k3", 6), ("two", None)}
    assert relational.picked(ids, ["nothing", "id", "name"]) == "id"
    assert relational.picked(ids, ["id"], "name") == "name"
    with pytest.raises(ValueError):
        relational.picked(ids, ["id"], "nothing")


def test_merged_means_skip_nulls(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 2, None), ("b", 1, None)], "k string, chunk int, v double")
    assert {tuple(x) for x in relational.merged_means(rows, ["k"], "chunk", "v").collect()} == {("a", 2, 3.0), ("b", 0, None)}


def test_row_correlations_without_spread_are_zero(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0)], "unit string, y_true double, y_pred double")
    got = dict(map(tuple, metrics.row_correlations(rows, "unit").collect()))
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0.0
