import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.sources import readers, sinks
from panelwright.streaming import ingest


def test_delimited_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,\n")
    (tmp_path / "a.tsv").write_text("x\ty\n1\ta,b\n")
    assert [tuple(r) for r in readers.delimited(spark, f"{tmp_path}/a.csv").collect()] == [("1", "a"), ("2", None)]
    assert [tuple(r) for r in readers.load("TSV", spark, f"{tmp_path}/a.tsv", columns=["y"]).collect()] == [("a,b",)]
    with pytest.raises(KeyError):
        readers.load("nothing")


def test_sets_maps_lists(spark, tmp_path):
    (tmp_path / "s.gmt").write_text("up\td\tA\tB\t\nother\td\tC\nempty\td\n")
    (tmp_path / "m.tsv").write_text(" p1 \t 12\np2\t\nbad\n")
    (tmp_path / "l.txt").write_text("1 2\n\n3  1\n")
    assert sorted(tuple(r) for r in readers.feature_sets(spark, f"{tmp_path}/s.gmt", {"up": 1, "gone": -1}).collect()) == [("up", "A", 1), ("up", "B", 1)]
    assert [tuple(r) for r in readers.id_map(spark, f"{tmp_path}/m.tsv").collect()] == [("p1", "12")]
    assert sorted(r[0] for r in readers.id_list(spark, f"{tmp_path}/l.txt").collect()) == ["1", "2", "3"]


def test_matrix_and_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,g1,g2\ns1,1.5,\ns2,x,2\n")
    assert sorted(tuple(r) for r in readers.matrix(spark, f"{tmp_path}/m.csv", "id").collect()) == [("s1", "g1", 1.5), ("s2", "g2", 2.0)]
    raw = tmp_path / "raw"
    raw.mkdir()
    for n in ("a", "b", "c"):
        (raw / n).write_text(n)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    m = spark.createDataFrame([("a", sha("a")), ("b", sha("other")), ("z", sha("z"))], "file string, sha256 string")
    assert sorted(tuple(r) for r in readers.manifest_violations(spark, str(raw), m).collect()) == [("b", "changed"), ("c", "unrecorded"), ("z", "missing")]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("s", "m", "u", "i", 1.0, 2.0, "extra")], "source string, method string, unit string, item string, y_true double, y_pred double, z string")
    sinks.predictions(p, f"{tmp_path}/p")
    assert set(spark.read.parquet(f"{tmp_path}/p").columns) == set(sinks.PREDICTION_COLUMNS)
    sinks.append(p, f"{tmp_path}/a")
    sinks.append(p, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2
    t = spark.createDataFrame([("d1", 1), ("d2", 2)], "drug string, x int")
    sinks.shards(t, spark.createDataFrame([("control", 0)], "drug string, x int"), "drug", f"{tmp_path}/s")
    assert sorted(r["x"] for r in sinks.shard(spark, f"{tmp_path}/s", "drug", "d1").collect()) == [0, 1]
    sinks.bundle(f"{tmp_path}/b", one=t, two=t)
    sinks.csv(t, f"{tmp_path}/c")
    sinks.json_lines(t, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_stream_keeps_the_last_word(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (90_000, "b", 1.0)], "t long, k string, v double").withColumn("ts", F.timestamp_seconds("t"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ingest.run_to_table(ingest.windowed_means(stream, "ts", "v", "k"), ["window_start", "k"])
    assert sorted((r["k"], r["n"], r["total"]) for r in out.collect()) == [("a", 2, 6.0), ("b", 1, 1.0)]


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a").write_text(folder)
    m = spark.createDataFrame([("x/a", hashlib.sha256(b"x").hexdigest()), ("y/a", hashlib.sha256(b"x").hexdigest())], "file string, sha256 string")
    assert [tuple(r) for r in readers.manifest_violations(spark, str(tmp_path), m).collect()] == [("y/a", "changed")]


def test_many_files_and_embeddings(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, "x")], "i int, s string").write.parquet(f"{tmp_path}/p{i}")
    assert sorted(r["i"] for r in readers.load("parquet", spark, *[f"{tmp_path}/p{i}" for i in range(3)], columns=["i"]).collect()) == [0, 1, 2]
    np.save(f"{tmp_path}/e.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position int, id string")
    assert {r["id"]: r["vector"] for r in readers.load("npy", spark, f"{tmp_path}/e.npy", ids).collect()} == {"a": [0, 1], "b": [2, 3], "c": [4, 5]}
    with pytest.raises(ValueError):
        readers.embeddings(spark, f"{tmp_path}/e.npy", ids.limit(2))
    with pytest.raises(KeyError):
        readers.load("cohort", spark, str(tmp_path), "nobody")


def test_contracts(spark):
    from panelwright.operators import contracts, signatures, splits

    p = spark.createDataFrame([("u", "i", 1.0, "x")], "unit string, item string, y_true double, y_pred string")
    assert contracts.require(p, "design") is p
    with pytest.raises(ValueError, match="y_pred is string"):
        contracts.require(p, "panel")
    f = spark.createDataFrame([("u", 1), ("u", 2)], "unit string, fold int")
    with pytest.raises(ValueError):
        contracts.require_disjoint(f)
    assert contracts.require_disjoint(f.limit(1)).count() == 1
    with pytest.raises(KeyError):
        splits.leave_classes_out(spark.createDataFrame([("u", "a")], "unit string, c string"), "c", ["a", "b"])
    with pytest.raises(KeyError):
        signatures.readouts(["nothing"], p, p)


def test_ridge_readout(spark):
    from panelwright.operators import signatures

    r = np.random.default_rng(2)
    x, t, y = r.normal(size=(30, 4)), r.normal(size=(10, 4)) * 3 + 1, r.normal(size=30)
    train = spark.createDataFrame([(f"s{i}", f"g{j}", float(x[i, j]), float(y[i])) for i in range(30) for j in range(4)], "sample string, feature string, value double, y double")
    target = spark.createDataFrame([(f"t{i}", f"g{j}", float(t[i, j])) for i in range(10) for j in range(3)] + [("t0", "other", 1.0)], "sample string, feature string, value double")
    z, zt = (x - x.mean(0)) / x.std(0), (t - t.mean(0)) / t.std(0)
    zt[:, 3] = 0
    want = -(y.mean() + zt @ np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y - y.mean())))
    got = {row["sample"]: row["score"] for row in signatures.readouts(["ridge"], train, target).collect()}
    assert np.allclose([got[f"t{i}"] for i in range(10)], want)
