"""Core operators against hand-computed answers, and every SQL against its query on the smallest tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.functions.ranks import table_avg_rank
from panelwright.operators import controls, deltas, matrix, metrics, models, relational, scores, selection, signatures, splits

PANEL = "unit string, item string, y_true double, y_pred double"


def one(df):
    return df.first()


def test_regret_by_hand(spark):
    p = spark.createDataFrame(
        [("A", "x", 0.0, 0.1), ("A", "y", 1.0, 0.2), ("A", "z", 2.0, 0.3), ("B", "x", 2.0, 0.1), ("B", "y", 1.0, 0.2), ("B", "z", 0.0, 0.3), ("C", "x", 1.0, 0.1), ("C", "y", 1.0, 0.2)], PANEL
    )
    got = {r["k"]: (r["regret"], r["units"]) for r in metrics.regret_at_k(p, 1, 3).collect()}
    assert got == {1: (0.5, 2), 3: (0.0, 2)}


def test_perfect_predictor(spark):
    rows = [(f"u{i}", f"d{j}", v, v) for i in range(5) for j in range(3) for v in [float((i * 7 + j * 3) % 11)]]
    p = spark.createDataFrame(rows, PANEL)
    assert one(metrics.interaction_rho(p))["interaction_rho"] == 1.0
    assert one(metrics.global_rho(p))["global_rho"] == 1.0
    assert 0 <= one(controls.permutation_p(p, 5, 1))["p"] <= 1


def test_flat_and_empty_panels(spark):
    p = spark.createDataFrame([(f"u{i}", "d", float(i), 1.0) for i in range(5)], PANEL)
    assert one(metrics.within_item_rho(p))["rho"] == 0.0
    assert one(metrics.within_item_rho(p.limit(0)))["rho"] is None
    assert one(metrics.per_item_spearman(p))["median_rho"] is None


def test_item_level_alone_is_no_interaction_when_balanced_both_ways(spark):
    r = random.Random(1)
    level = {f"d{j}": r.random() for j in range(6)}
    rows = [(f"u{i}", d, r.random(), v) for i in range(25) for d, v in level.items() if r.random() < 0.6]
    p = spark.createDataFrame(rows, PANEL)
    assert abs(one(metrics.interaction_rho_balanced(p))["interaction_rho"]) < 0.2


def test_table_rank_is_average_rank(spark):
    r = random.Random(2)
    x = [float(r.randrange(40)) for _ in range(500)]
    got = {i: v for i, v in table_avg_rank(spark.createDataFrame(list(enumerate(x)), "i long, v double"), "v", "r").select("i", "r").collect()}
    for i, v in enumerate(x):
        below, same = sum(w < v for w in x), sum(w == v for w in x)
        assert got[i] == below + (same + 1) / 2


def test_classification_readouts(spark):
    p = spark.createDataFrame([("a", "a", 1.0, 0.9), ("b", "b", 0.0, 0.2), ("c", "c", 0.0, 0.1), ("d", "d", 1.0, 0.8)], PANEL)
    assert one(metrics.top_k_hit_rate(p, 2, "unit"))["hit_rate"] == 1.0
    assert one(metrics.brier(p))["brier"] == round((0.01 + 0.04 + 0.01 + 0.04) / 4, 6)
    assert one(metrics.top_k_hit_rate(p.where("y_true = 0"), 2, "unit"))["hit_rate"] is None
    sure = spark.createDataFrame([("a", "a", 1.0, 1.0), ("b", "b", 0.0, 0.0)], PANEL)
    assert one(metrics.expected_calibration_error(sure))["ece"] == 0.0


def test_concentration_and_classes(spark):
    p = spark.createDataFrame([(u, d, t, q) for u in "ABCD" for d, t, q in (("tox", 0.0, 0.0), ("mid", 1.0, 0.5), ("weak", 2.0, 1.0))], PANEL)
    got = one(selection.concentration(p, "y_true"))
    assert (got["distinct_items"], got["modal_item"], got["modal_share"], got["active_share"]) == (1, "tox", 1.0, 1.0)
    c = spark.createDataFrame([("tox", "k"), ("mid", "k")], "item string, class string")
    assert {r["k"]: r["hit_rate"] for r in selection.class_hit_rate(p, c, 1, 2).collect()} == {1: 1.0, 2: 1.0}


def test_log_scale_ignores_depth(spark):
    m = spark.createDataFrame([(s, f, v * k) for s, k in (("a", 1.0), ("b", 2.0)) for f, v in (("x", 1.0), ("y", 3.0), ("z", 0.0))] + [("c", "x", 0.0)], "sample string, feature string, value double")
    got = {(r[0], r[1]): r[2] for r in matrix.scaled(m, 1e4, log=True).collect()}
    assert all(math.isclose(got["a", f], got["b", f]) for f in "xyz") and got["c", "x"] == 0.0


def test_scatter_sums_and_drops(spark):
    t = spark.createDataFrame([(1, [10, 20, 10, 99], [0.5, 2.0, 0.5, 7.0]), (2, [30], [3.0])], "cell int, ids array<int>, values array<double>")
    n = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "token int, feature string")
    assert sorted(tuple(r) for r in matrix.scatter(t, n).collect()) == [(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)]


def test_additive_and_left_out(spark):
    d = spark.createDataFrame([("L1", "d", "g", 1.0), ("L2", "d", "g", 5.0), ("L1", "e", "g", 2.0)], "line string, drug string, feature string, value double")
    assert {r["drug"]: r["value"] for r in deltas.additive(d).collect()} == {"d": 3.0, "e": 2.0}
    assert {(r["line"], r["drug"]): r["value"] for r in deltas.additive_left_out(d).collect()} == {("L1", "d"): 5.0, ("L2", "d"): 1.0}


def test_fidelity_of_the_real_profile(spark):
    real = [(f"L{i}", "d", f"g{j}", float((i * 5 + j * j * (i + 1)) % 7)) for i in range(4) for j in range(6)]
    df = spark.createDataFrame(real, "line string, drug string, feature string, value double")
    got = deltas.fidelity(df, df, 6).collect()
    assert len(got) == 4 and all(abs(r["r"] - 1) < 1e-6 and r["rank"] == 1.0 for r in got)


def test_real_delta_needs_controls(spark):
    c = spark.createDataFrame(
        [("1", "A", "d", False, "g", 3.0), ("2", "A", "d", False, "h", 1.0), ("3", "A", "c", True, "g", 1.0), ("4", "B", "d", False, "g", 1.0)],
        "cell string, line string, drug string, is_control boolean, feature string, value double",
    )
    got = {(r["line"], r["feature"]): r["value"] for r in deltas.real_deltas(c).collect()}
    assert set(got) == {("A", "g"), ("A", "h")} and got["A", "h"] > 0 > got["A", "g"]


def test_signatures(spark):
    m = spark.createDataFrame([(f"s{i}", f"g{j}", float(i if j < 2 else 3 - i)) for i in range(4) for j in range(4)], "sample string, feature string, value double")
    s = spark.createDataFrame([("up", "g0", 1), ("up", "g1", 1), ("gone", "zz", 1)], "signature string, feature string, direction int")
    got = signatures.sensitivity(m, s).collect()
    assert {r["signature"] for r in got} == {"up"} and max(got, key=lambda r: r["score"])["sample"] == "s3"


def test_leakage(spark):
    d = spark.createDataFrame([(u, i) for u in ("L1", "L2", "L3") for i in ("d1", "d2")], "unit string, item string")
    u, i = spark.createDataFrame([("L1",)], "unit string"), spark.createDataFrame([("d1",)], "item string")
    assert relational.without_leakage(d, u, i, False).count() == 5
    assert relational.without_leakage(d, u, i.limit(0), True).count() == 4
    assert relational.without_leakage(d, u, i.limit(0), False).count() == 6


def test_folds_cover_once(spark):
    d = spark.createDataFrame([(f"u{i}",) for i in range(60) for _ in range(1 + i % 4)], "unit string")
    for f in (splits.hashed_folds(d, 5), splits.balanced_group_folds(d, 5), splits.leave_key_out(d, "unit")):
        assert f.count() == 60 == f.select("unit").distinct().count()
    n = [r[0] for r in splits.balanced_group_folds(d, 5).groupBy("fold").agg(F.sum("n")).select("sum(n)").collect()]
    assert max(n) - min(n) <= 4


def test_permutation_keeps_marginals(spark):
    p = spark.createDataFrame([(f"u{i}", f"d{j}", float(i * 3 + j), 0.0) for i in range(9) for j in range(3)], PANEL)
    q = controls.permuted_within_item(p, 2, 4)
    for b in (0, 1):
        assert sorted(tuple(r) for r in q.where(F.col("b") == b).select("item", "y_true").collect()) == sorted(tuple(r) for r in p.select("item", "y_true").collect())


def test_ridge_and_lasso_from_moments(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 4))
    y = x @ np.array([1.0, -2.0, 0.0, 0.5]) + 3 + 0.1 * r.normal(size=300)
    df = spark.createDataFrame([(int(i % 2), x[i].tolist(), float(y[i]), int(i % 5)) for i in range(300)] + [(0, None, 1.0, 0)], "g int, x array<double>, y double, fold int")
    m = {row["g"]: models.square(row["m"]) for row in models.moments(df, ["g"], "x", "y").collect()}
    xx, yy = x[::2], y[::2]
    xc, yc = xx - xx.mean(0), yy - yy.mean()
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(4), xc.T @ yc)
    assert np.allclose(models.ridge(m[0], 2.0)[1:], want)
    w = models.elastic_net(m[0], 0.1, 1.0)[1:]
    grad = xc.T @ (yc - xc @ w) / len(yc)
    assert np.all(np.abs(grad) <= 0.1 + 1e-6) and abs(w[2]) < 1e-9
    assert abs(models.rss(m[0], models.ridge(m[0], 0.0)) - ((yc - xc @ np.linalg.lstsq(xc, yc, rcond=None)[0]) ** 2).sum()) < 1e-6
    assert models.fitted(df, ["g"], "x", "y", "fold", alphas=(1.0, 100.0)).count() == 2


def test_components_explain_variance(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 5)) * np.array([5.0, 2.0, 1.0, 0.5, 0.1])
    df = spark.createDataFrame([(x[i].tolist(),) for i in range(200)], "x array<double>")
    _, v, var = models.components(df, "x", 2)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.allclose(var, want) and np.allclose(v.T @ v, np.eye(2))


@pytest.mark.parametrize(("raw", "want"), [("[('X', 0.05, 'uM')]", 0.05), ("[('X', 5.0, 'uM')]", 5.0), ("bad", None), (None, None)])
def test_dose(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(T.dose(F.col("x"))).first()[0] == want


def test_scalar_functions(spark):
    df = spark.createDataFrame([("sarc0012_tumor",), ("SARC0012_B",), ("none",), (None,)], "x string")
    assert [r[0] for r in df.select(T.subject_id(F.col("x"), "sarc")).collect()] == ["SARC0012", "SARC0012_B", None, None]
    assert [r[0] for r in df.select(T.specimen(F.col("x"), "sarc")).collect()] == ["Tumor", None, None, None]
    ids = spark.createDataFrame([("1923.0",), ("x",), (None,)], "x string")
    assert [r[0] for r in ids.select(T.digits_only_id(F.col("x"))).collect()] == ["1923", "", ""]


def test_complete_cases_and_keep_first(spark):
    cells = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "b"), ("r3", "a"), ("r3", "c")], "r string, c string")
    assert sorted(tuple(x) for x in relational.complete_cases(cells, "r", "c", 0.7).select("r", "c").collect()) == [("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "b")]
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 5, "c")], "k string, o int, v string")
    assert sorted(r["v"] for r in relational.keep_first(df, ["k"], ["o"]).collect()) == ["a", "c"]


def test_readouts_take_every_coordinate(spark, tmp_path):
    from panelwright.plans import models as plans

    r = np.random.default_rng(4)
    x = r.normal(size=(120, 20)) * np.arange(1, 21) + 5
    x[:, 7] = 3.0
    y = r.integers(0, 10, 120)
    spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(120)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 1e-9, sd, 1)
    want = y.mean() + z @ np.linalg.solve(z.T @ z + np.eye(20), z.T @ (y - y.mean()))
    got = [row["y_pred"] for row in plans.v3_all(spark, str(tmp_path)).orderBy("vec_id").collect()]
    assert np.allclose(got, want, atol=1e-5)


def test_boosting_keeps_all_slopes_and_rounds(spark):
    import inspect

    r = np.random.default_rng(5)
    df = spark.createDataFrame([(r.normal(size=20).tolist(), float(i % 7)) for i in range(60)], "x array<double>, y double")
    model, _ = models.boosted(df, "x", "y", [0.0, *np.arange(1.0, 20.0)], rounds=2)
    assert (model.numFeatures, model.getNumTrees) == (19, 2)
    assert {k: v.default for k, v in inspect.signature(models.boosted).parameters.items() if k in ("most", "rounds")} == {"most": 300, "rounds": 400}


def test_penalties_are_chosen_by_the_other_folds(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(90, 3)) * [1.0, 40.0, 0.01] + 2
    y = x @ np.array([1.0, 0.02, 30.0]) + r.normal(size=90)
    fold = np.arange(90) % 5
    data = [("a", x[i].tolist(), float(y[i]), int(fold[i])) for i in range(90)] + [("few", x[i].tolist(), float(y[i]), i % 5) for i in range(7)]
    df = spark.createDataFrame(data, "item string, x array<double>, y double, fold int")

    def ridge(a, b, alpha):
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + alpha * np.eye(3), (a - a.mean(0)).T @ (b - b.mean()))
        return np.array([b.mean() - a.mean(0) @ w, *w])

    got = {(g["item"], g["fold"]): g for g in models.out_of_fold(df, ["item"], "x", "y", "fold", "ridge").collect()}
    assert set(got) == {("a", f) for f in range(5)}
    for f in range(5):
        tr = fold != f
        z = x / x[tr].std(0)
        errors = {}
        for alpha in np.logspace(-2, 3, 12):
            fits = {j: ridge(z[tr & (fold != j)], y[tr & (fold != j)], alpha) for j in range(5) if j != f}
            errors[alpha] = sum(((y[fold == j] - w[0] - z[fold == j] @ w[1:]) ** 2).sum() for j, w in fits.items())
        best = min(errors, key=errors.get)
        w = ridge(z[tr], y[tr], best)
        assert np.isclose(got["a", f]["alpha"], best) and np.allclose(got["a", f]["w"], [w[0], *(w[1:] / x[tr].std(0))], atol=1e-6)
    for kind in ("lasso", "elastic_net"):
        assert 0 < min(g["alpha"] for g in models.out_of_fold(df, ["item"], "x", "y", "fold", kind).collect())


def made_panel(spark, target, seed=7, units=80, items=6, k=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(units, k)) * np.arange(1, k + 1)
    rows = [(f"u{i}", f"d{j}", float(target(r, x[i], j))) for i in range(units) for j in range(items)]
    panel = spark.createDataFrame(rows, "unit string, item string, y_true double").cache()
    return panel, spark.createDataFrame([(f"u{i}", x[i].tolist()) for i in range(units)], "unit string, vector array<double>").cache(), splits.hashed_folds(panel, 5).cache()


@pytest.mark.parametrize("per_item", [True, False])
def test_noise_is_not_predicted_out_of_fold(spark, per_item):
    panel, v, folds = made_panel(spark, lambda r, x, j: r.normal(), units=400)
    r = models.cross_validated(panel, folds, models.fold_components(v, folds, "vector", 5), per_item=per_item, alphas=(0.1,))
    rho = one(metrics.within_item_rho(r.select("item", "y_true", r["y_resid"].alias("y_pred"))))
    assert rho["n"] == 2400 and abs(rho["rho"]) < 0.05


def test_slopes_are_found_out_of_fold(spark):
    panel, v, folds = made_panel(spark, lambda r, x, j: j + (j - 2) * x[4] / 5 + 0.1 * r.normal())
    spaces = models.fold_components(v, folds, "vector", 5)
    rho = {k: one(metrics.interaction_rho(models.cross_validated(panel, folds, spaces, per_item=k)))["interaction_rho"] for k in (True, False)}
    assert rho[True] > 0.9 and rho[False] < 0.3  # one slope for all items can't say an interaction


def test_fold_components_know_nothing_of_the_fold(spark):
    _, v, folds = made_panel(spark, lambda r, x, j: 0.0)
    fold = dict(folds.collect())
    far = v.withColumn("vector", F.when(F.col("unit").isin([u for u, f in fold.items() if f == 0]), F.transform("vector", lambda x: x * 1000 + 9)).otherwise(F.col("vector")))
    a, b = ({r["unit"]: r["x"] for r in models.fold_components(t, folds, "vector", 3).where("f = 0").collect()} for t in (v, far))
    assert all(np.allclose(a[u], b[u]) for u, f in fold.items() if f != 0)


def test_kernel_width_is_chosen_in_the_training_folds(spark):
    from panelwright.plans import models as plans

    panel, v, folds = made_panel(spark, lambda r, x, j: x[0] if j % 2 else np.sin(3 * x[0]), units=150)
    spaces = models.fold_components(v, folds, "vector", 5, unit_spread=True)
    rows = models.cross_validated(panel, folds, spaces, alphas=tuple(np.logspace(-2, 3, 6)), reshape=plans.kernels)
    assert rows.count() == rows.select("unit", "item").distinct().count() == 150 * 6
    rho = {r["item"]: r["rho"] for r in metrics.rho_by_item(rows).collect()}
    assert min(rho[f"d{j}"] for j in (1, 3, 5)) > 0.5


def test_planted_response_is_recovered_the_more_the_stronger(spark):
    from panelwright.operators import scores

    panel, v, folds = made_panel(spark, lambda r, x, j: j, units=200)
    spaces = models.reduced(models.standardised(v, "vector"), "vector", 3).select("unit", "x")
    made = scores.planted_response(panel, spaces, (0.0, 0.5, 3.0), 1.0, 3)
    r = models.cross_validated(made, folds, models.fold_components(v, folds, "vector", 5), items=("effect", "item"))
    rho = {x["effect"]: x["rho"] for x in metrics.within_item_rho(r.select("effect", "item", "y_true", r["y_resid"].alias("y_pred")), "effect").collect()}
    assert rho[0.0] < 0.15 and rho[0.0] < rho[0.5] < rho[3.0] and rho[3.0] > 0.8


def test_a_constant_prediction_is_no_interaction_at_any_scale(spark):
    for scale in (1e-10, 1.0, 1e9):
        rows = [(f"u{i}", f"d{j}", float((i * 7 + j * 5) % 11), scale * (0.1 + i / 3)) for i in range(12) for j in range(5)]
        assert one(metrics.interaction_rho(spark.createDataFrame(rows, PANEL)))["interaction_rho"] == 0.0


def test_a_hot_key_is_ranked_in_parts(spark):
    from panelwright.functions.ranks import dealt, group_avg_rank, leave_one_out_mean

    r = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", r.choice([float(i), 5.0, None])) for i in range(900)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = group_avg_rank(df, ["k"], {"v": "r"}, buckets=8)
    for k, v, rank in [tuple(x) for x in got.select("k", "v", "r").distinct().collect()]:
        held = [w for kk, w in rows if kk == k and w is not None]
        assert rank == (None if v is None else sum(w < v for w in held) + (held.count(v) + 1) / 2)
    assert got.count() == 900
    d = dealt(df.where("k IS NOT NULL").withColumn("i", F.monotonically_increasing_id()), ["k"], F.md5(F.col("i").cast("string")), "n")
    assert all(x["n"] == list(range(1, len(x["n"]) + 1)) for x in d.groupBy("k").agg(F.sort_array(F.collect_list("n")).alias("n")).collect())
    m = leave_one_out_mean(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double"), ["k"], "v", "m")
    assert sorted((x["v"], x["m"]) for x in m.collect()) == [(1.0, 3.0), (3.0, 1.0), (5.0, None)]


def test_vocabularies_are_refused_not_cut(spark):
    from panelwright.session import vocabulary

    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string")
    assert vocabulary(df, "x", 3) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        vocabulary(df, "x", 2)


def test_personalization_meets_kinds_of_units_not_units(spark, monkeypatch):
    wide = spark.range(3000).select(F.col("id").alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("item")).where("unit % 7 <> item")
    panel = wide.select("unit", "item", F.pmod(F.col("item") * (F.col("unit") % 3), F.lit(4)).cast("double").alias("y_pred"))
    held = []
    monkeypatch.setattr(metrics, "checkpointed", lambda df: held.append(df.localCheckpoint()) or held[-1])
    assert one(metrics.personalization(panel))["pairs"] == sum(1 for u in range(3000) for v in range(u) if 5 - len({u % 7, v % 7} & set(range(5))) >= 4)
    assert held[0].count() <= 21 and held[0].agg(F.sum("units")).first()[0] == 3000


def test_fidelity_copies_few_blocks_and_finds_the_same(spark, monkeypatch):
    r = random.Random(5)
    real = spark.createDataFrame([(f"l{i}", f"d{i % 2}", f"f{j}", r.gauss(0, 1)) for i in range(40) for j in range(6)], "line string, drug string, feature string, value double")
    made = real.withColumn("value", F.round("value", 0))
    whole = sorted(map(tuple, deltas.fidelity(made, real, 6).collect()))
    monkeypatch.setattr(deltas, "TILE", 3)
    again = sorted(map(tuple, deltas.fidelity(made, real, 6, block=7).collect()))
    assert [x[:2] for x in whole] == [x[:2] for x in again] and np.allclose([x[2:] for x in whole], [x[2:] for x in again])
    # 180,000 rows of 15 numbers are copied for a handful of blocks, not for 352
    assert math.ceil(180_000 / max(512, deltas.CELLS // 15)) == 6


def test_draws_in_batches_and_by_ranges_are_the_same(spark, monkeypatch):
    r = random.Random(3)
    panel = spark.createDataFrame([(u, f"i{i}", round(r.random(), 2), round(r.random(), 1)) for u in range(40) for i in range(5) if r.random() < 0.9], "unit long, item string, y_true double, y_pred double")
    whole = sorted(map(tuple, controls.null_rhos(panel, 6, 7).collect()))
    monkeypatch.setattr(controls, "AT_ONCE", 500)
    assert sorted(map(tuple, controls.null_rhos(panel, 6, 7).collect())) == whole
    monkeypatch.setattr(controls, "HOT_ITEM", 10)
    assert sorted(map(tuple, controls.null_rhos(panel, 6, 7).collect())) == whole
    assert [b for b, _ in whole] == list(range(-1, 6))


def test_signature_draws_are_columns_and_the_same_as_rows(spark, monkeypatch):
    r = random.Random(5)
    units, items, features = range(30), ["i1", "i2", "i3"], [f"f{k}" for k in range(7)]
    made = spark.createDataFrame([(u, i, f, r.random()) for u in units for i in items for f in features if r.random() < 0.8], "line long, drug string, feature string, value double")
    design = spark.createDataFrame([(u, i, round(r.random(), 1)) for u in units for i in [*items, "i4"] if r.random() < 0.9], "unit long, item string, y_true double")
    sets = spark.createDataFrame([("a", "f0", 1), ("a", "f1", 1), ("b", "f2", 1), ("b", "f3", -1), ("c", "f4", 1), ("d", "f9", 1)], "signature string, feature string, direction int")

    def scored(n):
        return sorted(map(tuple, scores.score_signatures(made.limit(n), design, sets, 5, 4, 3).collect()))

    whole = 10**6
    with monkeypatch.context() as m:
        m.setattr(controls, "HOT_ITEM", 1)  # drawn as rows
        want = scored(whole)
    with monkeypatch.context() as m:
        m.setattr(controls, "permuted_within_item", None)  # a draw's rows are not made
        assert scored(whole) == want
        m.setattr(controls, "AT_ONCE", 300)
        assert scored(whole) == want
    assert [x[:2] for x in want] == [("a", 2), ("b", 2), ("c", 1)] and want[0][5] == want[1][5]  # of one size, with the same random sets
    assert scored(0) == []


def test_real_deltas_in_parts_are_the_same(spark, monkeypatch):
    r = random.Random(6)
    drug = {0: "d0", 1: "d1", 2: None}
    rows = [(f"c{c}", c % 7 if c % 50 else None, drug[c % 3], None if c % 41 == 0 else c % 4 == 0, f"f{r.randrange(4)}", float(r.randrange(5))) for c in range(400) for _ in range(2)]
    cells = spark.createDataFrame(rows, "cell string, line long, drug string, is_control boolean, feature string, value double")
    want = {tuple(x[:3]): x[3] for x in deltas.real_deltas(cells).collect()}
    monkeypatch.setattr(deltas, "AT_ONCE", 90)
    got = {tuple(x[:3]): x[3] for x in deltas.real_deltas(cells).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and {k[1] for k in got} == {"d0", "d1"}
    assert deltas.real_deltas(cells.limit(0)).count() == 0
