"""End to end on planted Gaussians, and the parts that hold state."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import admission, components, graph, metrics, prototypes
from lodestar.plans import model as models
from lodestar.plans import runner
from lodestar.plans import presets
from lodestar.plans.config import ExperimentConfig, ModelConfig
from lodestar.sources import tables
from lodestar.streaming.buffer import Buffer, bounded, start

SMALL = ModelConfig(scaler="standard", map_width=64, projection_width=16, gamma="knn-10", refresh_calibration="held")


def planted(spark, classes=4, rows=200, width=6, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((classes, width)) * 6
    out = []
    for c in range(classes):
        for x in centers[c] + rng.standard_normal((rows, width)):
            out.append((len(out), f"c{c:02d}", *map(float, x), 1.0))
    names = ", ".join(f"f{i} double" for i in range(width))
    df = spark.createDataFrame(out, f"row_id long, label string, {names}, constant double").cache()
    part = lambda *m: df.where((F.col("row_id") % 5).isin(*m))
    return part(0, 1, 2), part(3), part(4)


def test_sessions_admit_new_classes_and_reject_unseen(spark, tmp_path):
    train, held, test = planted(spark)
    told = []
    config = ExperimentConfig(SMALL, base_ratio=0.75, shots=5, class_seed=3)
    predictions, scored = runner.run_sessions(train, held, test, config, f"file://{tmp_path}", lambda e, p: told.append(e))
    rows = {r["session_id"]: r for r in scored.collect()}
    assert sorted(rows) == [0, 1] and told.count("admitted") == 1
    assert rows[0]["ccr"] > 0.6 and rows[0]["tur"] > 0.5
    assert rows[1]["n_true_unknown"] == 0 and rows[1]["ccr"] > 0.3
    assert metrics.run_metrics(scored).first()["os_hm"] > 0.5
    novel = predictions.where("session_id = 1").select("predicted_label").distinct().count()
    assert novel == 5  # four classes and unknown
    again = spark.read.parquet(f"file://{tmp_path}/predictions")
    assert again.count() == predictions.count()


def test_prediction_does_not_depend_on_partitions(spark):
    train, held, test = planted(spark, 3)
    fitted = models.fit(train, held, SMALL.with_(projection="pca"))
    a = models.predict(fitted, test.repartition(1)).orderBy("row_id").select("row_id", "predicted_label").collect()
    b = models.predict(fitted, test.repartition(5)).orderBy("row_id").select("row_id", "predicted_label").collect()
    assert a == b


@pytest.mark.parametrize("change", [{"threshold": "grid", "mode": "energy"}, {"threshold": "loco", "residual": "preserve"}, {"threshold": "evt", "map_kind": "identity"}, {"threshold": "per_class", "residual": "merge"}, {"threshold": "per_prototype", "pre_whitening": True, "post_whitening": True}, {"mode": "evm", "map_kind": "nystrom", "map_width": 24}, {"balance_power": 0.5, "augment_below": 40, "mode": "hyperspherical"}])
def test_variants_fit_and_predict(spark, change):
    train, held, test = planted(spark, 3, 30)
    fitted = models.fit(train, held, SMALL.with_(**change))
    assert models.predict(fitted, test).count() == test.count() and np.isfinite(fitted.tau)


@pytest.mark.parametrize("dataset", sorted(presets.TUNED))
def test_presets_pin_the_model_seed_and_the_mode(dataset):
    for config in (presets.fixed(43), presets.tuned(dataset, 43)):
        assert config.model.seed == 42 and config.class_seed == 43 and config.model.mode == "min_distance"
    assert presets.fixed(42).model.gamma == "knn-20" and presets.fixed(42).model.tau_quantile == 0.85


def test_config_is_checked():
    for bad in ({"mode": "x", "scaler": "none"}, {"alpha": 0.0}, {"tiny_rows": 0}):
        with pytest.raises(ValueError):
            ModelConfig(**bad)


def test_mutual_graph_is_symmetric_and_chunks_change_nothing(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, "ab"[i % 2], rng.standard_normal(4).tolist()) for i in range(80)], "row_id long, label string, x array<double>")
    one = graph.nearest(rows, 4).select("src", "dst", "rank").orderBy("src", "rank").collect()
    assert graph.nearest(rows, 4, chunk=17).select("src", "dst", "rank").orderBy("src", "rank").collect() == one
    edges = {(r["src"], r["dst"]) for r in graph.mutual(graph.nearest(rows, 4)).collect()}
    assert edges and edges == {(b, a) for a, b in edges}


def test_components_of_chains_stars_loops_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(300, 300), (1, 0), (None, 5)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[200 + i] for i in range(30)} == {100} and found[300] == 300
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_bank_is_capped_and_gates_hold():
    centers = np.array([[0.0, 0], [0.1, 0], [5, 5], [5.2, 5]])
    bank = prototypes.Bank(list("abcd"), ["x", "x", "y", "y"], centers, np.ones(4), np.ones(4), ["stable"] * 4)
    assert prototypes.closest_pair(bank)[1:] == (0, 1)
    assert sorted(prototypes.capped(bank, 2).labels) == ["x", "y"]
    with pytest.raises(ValueError):
        prototypes.capped(bank, 1)
    near = prototypes.Bank(["n"], ["z"], np.array([[0.05, 0.0]]), np.ones(1), np.ones(1), ["provisional"])
    assert not admission.passes_margin(near, bank, 0.5, 0.0)
    assert admission.affine_residual(np.array([[1.0, 0]]), np.array([[0.0, 0], [2, 0]])) == pytest.approx(0)
    assert admission.affine_residual(np.zeros((1, 2)), np.zeros((0, 2))) == float("inf")


def test_buffer_replays_to_the_batch_result(spark, tmp_path):
    schema = "seq long, value double, accepted boolean"
    for i in range(3):
        rows = [(10 * i + j, float(j), j % 2 == 0) for j in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    buffer = Buffer(spark, f"file://{tmp_path}/buffer", schema, 6)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    start(stream, lambda df: df, buffer, f"file://{tmp_path}/checkpoint").awaitTermination()
    expected = bounded(spark.read.parquet(f"file://{tmp_path}/in").where("NOT accepted"), 6)
    assert sorted(r["seq"] for r in buffer.read().collect()) == sorted(r["seq"] for r in expected.collect())
    kept, recovered = buffer.rescore(lambda df: df.withColumn("accepted", F.col("value") > 5))
    assert recovered + kept.count() == 6


def test_sources_and_sinks(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "t.csv").write_text("﻿ Label ,n\nDoS-Hulk,1\n,2.5\n", encoding="utf-8")
    rows = tables.labelled(tables.read_csv(spark, f"{path}/t.csv"), numbers=True)
    assert sorted((r["label"], r["n"]) for r in rows.collect()) == [("dos_hulk", 1.0), ("unknown", 2.5)]
    assert {r["label"]: r["rows"] for r in tables.profile(rows).collect()} == {"dos_hulk": 1, "unknown": 1}
    (tmp_path / "m.json").write_text(json.dumps({"name": "t", "splits": {"test": "t.csv"}}))
    assert tables.Manifest.load(spark, f"{path}/m.json").read(spark, "test").count() == 2
    with pytest.raises(ValueError):
        tables.Manifest("t", {"train": "x"})
    for i, status in enumerate(["ok", "failed", "ok"]):
        tables.append_event(spark, f"{path}/log", "cell", {"tag": "a", "status": status, "seq": i})
    log = tables.read_events(spark, f"{path}/log", "tag string, status string, seq long")
    assert [r["seq"] for r in tables.finished(log).collect()] == [2]
    run = tmp_path / "run" / "session_2_x"
    run.mkdir(parents=True)
    (run / "p.csv").write_text("true_label,predicted_label,accepted,score,threshold\nnull,a,true,1,2\n")
    assert tables.read_run(spark, f"{path}/run").first()["session_id"] == 2
