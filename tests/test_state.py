"""Whole models saved and loaded, archives, pending items, ensembles, runs."""

import json
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import metrics, prototypes
from lodestar.plans import model as models
from lodestar.plans import runner, state
from lodestar.plans.config import ExperimentConfig, TinyConfig
from lodestar.sources import configs, tables
from tests.test_model import SMALL, planted

FAST = SMALL.with_(map_kind="identity", scale_mode="absolute", projection="pca", projection_width=4)


@pytest.fixture(scope="module")
def fitted(spark):
    train, held, test = planted(spark, 4, 60)
    base = lambda df: df.where("label <> 'c03'")
    config = SMALL.with_(mode="mahalanobis", map_width=32, projection_width=8, penalty=("log", 0.1), max_classes=4, local_affine=True, affine_local=1e-6, affine_global=1e-6, margin=0.0)
    return models.fit(base(train), base(held), config), train, held, test


def told(df):
    return sorted(map(str, df.collect()))


def test_a_loaded_model_predicts_the_same(spark, fitted, tmp_path):
    model, train, _, test = fitted
    model = models.archive_class(model, "c02")
    state.save(model, f"file://{tmp_path}/m")
    again = state.load(spark, f"file://{tmp_path}/m")
    assert told(models.predict(again, test)) == told(models.predict(model, test))
    assert again.config == model.config and again.fitted == model.fitted and again.scales == model.scales
    assert told(again.archive.drop("phi")) == told(model.archive.drop("phi"))
    few = train.where("label = 'c03'").limit(3)
    assert models.admit(again, few)[1] == models.admit(model, few)[1]


def test_archived_classes_come_back_when_refreshed(fitted):
    model, train, _, test = fitted
    away = models.archive_class(model, "c01")
    assert "c01" not in away.classes and away.support.where("label = 'c01'").count() == 0
    assert away.archive.count() == model.support.where("label = 'c01'").count()
    kept = models.retained(away, ["c01"], 0.0).count()
    assert kept == away.archive.count()
    assert models.retained(models.replace(away, config=away.config.with_(rehydrate=False)), ["c01"], 0.0).count() == 0
    back = models.refresh(away, train.where("label = 'c01'").limit(4), now=1.0, force=("c01",))
    assert "c01" in back.classes and back.support.where("label = 'c01'").count() > 4 and back.archive.count() == 0
    assert back.version == model.version + 1


def test_classes_of_least_support_make_room(fitted):
    model, train, _, _ = fitted
    tight = models.replace(model, config=model.config.with_(max_classes=3))
    out = models.refresh(tight, train.where("label = 'c03'").limit(6), now=1.0, force=("c03",))
    assert "c03" in out.classes and len(out.classes) == 3 and out.archive.select("label").distinct().count() == 1
    with pytest.raises(ValueError, match="over budget"):
        models.check_budgets(model.support, model.config.with_(max_units=1))


def test_pending_items_and_cluster_admission(spark, fitted):
    model, train, _, test = fitted
    model = models.replace(model, scales=models.replace(model.scales, tau_sep=0.1), config=model.config.with_(local_affine=False))
    batch = train.where("label = 'c03'").limit(20)
    items, payloads = state.cache_batch(model, None, None, batch, "b1", 1.0)
    items, payloads = state.cache_batch(model, items, payloads, batch, "b1", 2.0)  # again: nothing changes
    assert [(r["item_id"], r["rows"], r["created_at"]) for r in items.collect()] == [("b1:c03", 20, 1.0)]
    assert state.payload(items, payloads, "b1:c03").count() == 20
    with pytest.raises(KeyError):
        state.payload(items, payloads, "b2:c03")
    served, outcome = models.admit_cluster(model, batch, "b1:c03")
    assert outcome == {"c03": "provisional"} and "c03" in served.classes
    assert {s for x, s in zip(served.bank.labels, served.bank.status, strict=True) if x == "c03"} == {prototypes.PROVISIONAL}
    again, _ = models.admit_cluster(served, batch, "b1:c03")
    assert again.bank.ids == served.bank.ids
    near = models.replace(model, scales=models.replace(model.scales, eta_margin=1e9))
    assert models.admit_cluster(near, batch, "b1:c03")[1] == {"c03": "blocked_by_margin"}
    assert state.sanity(served, items)["pending_count"] == 1 and state.sanity(served)["provisional_prototype_count"] > 0


def test_one_sample_and_unready_models(spark, fitted):
    model, _, _, test = fitted
    row = test.first().asDict()
    alone = models.predict_one(model, spark, {k: v for k, v in row.items() if k != "row_id"})
    among = models.predict(model, test).where(F.col("row_id") == row["row_id"]).first()
    assert alone["predicted_label"] == among["predicted_label"] and alone["score"] == pytest.approx(among["score"])
    with pytest.raises(ValueError):
        models.predict_one(model, spark, {})
    with pytest.raises(ValueError, match="no prototypes"):
        models.predict(models.replace(model, bank=model.bank.only([])), test)


def test_records_of_a_state(fitted):
    model, *_ = fitted
    one, both = state.snapshot(model), state.snapshot([model, models.replace(model, tau=model.tau + 2, version=3)])
    assert one["known_labels"] == ["c00", "c01", "c02"] and both["tau"] == pytest.approx(model.tau + 1) and both["projection_version"] == 3
    meta = state.metadata(model)
    assert meta["members"][0]["thresholds"]["tau_sep"] == pytest.approx(1.1 * model.tau) and json.dumps(meta)
    assert state.plain({"a": np.float32(1.5), "p": Path("x/y"), "t": (1, np.array([2])), "s": {"b", "a"}, "n": float("nan")}) == {"a": 1.5, "p": "x/y", "t": [1, [2]], "s": ["a", "b"], "n": [state.NUMBER, "nan"]}


def test_ensembles_agree_with_a_plain_count(spark):
    rows = [
        (0, 0, "a", True, 1.0, 2.0), (0, 1, "b", True, 1.5, 2.0), (0, 2, "b", True, 1.7, 2.0),
        (1, 0, "a", True, 1.0, 2.0), (1, 1, "unknown", False, 9.0, 2.0), (1, 2, "unknown", False, 9.0, 2.0),
        (2, 0, "a", True, 1.0, 2.0), (2, 1, "b", True, 1.0, 2.0), (2, 2, "unknown", False, 2.5, 2.0),
    ]
    df = spark.createDataFrame([(*r, r[2], f"p{r[1]}", "stable", r[1]) for r in rows], "row_id long, member int, predicted_label string, accepted boolean, score double, threshold double, best_class_label string, best_prototype_id string, best_prototype_status string, projection_version int")
    found = {r["row_id"]: r for r in metrics.ensemble(df, "row_id", 3).collect()}
    assert (found[0]["predicted_label"], found[0]["best_prototype_id"], found[0]["score"]) == ("b", "p1", pytest.approx(1.4))
    assert (found[1]["predicted_label"], found[1]["accepted"], found[1]["best_prototype_id"]) == ("unknown", False, "p0")
    assert found[2]["predicted_label"] == "a" and found[2]["projection_version"] == 2
    votes = {r["row_id"]: r["accepted"] for r in metrics.ensemble(df, "row_id", 3, "majority").collect()}
    assert votes == {0: True, 1: False, 2: True}
    assert not metrics.ensemble(df, "row_id", 3, "max").where("row_id = 2").first()["accepted"]


def test_bursts_with_an_ensemble_write_their_records(spark, tmp_path):
    train, held, test = planted(spark, 3, 40)
    config = TinyConfig(ExperimentConfig(FAST), bursts=(2, 4), episodes=1, members=2, refresh_every=2, promoted_refresh_every=1)
    stages, episodes, aggregate = runner.run_tiny(train, held, test, config, f"file://{tmp_path}")
    assert [(r["stage"], r["is_refresh"]) for r in stages.orderBy("stage").collect()] == [(0, False), (1, False), (2, True)]
    row = episodes.first()
    assert row["promotion_stage"] == 2 and row["refreshes"] == 1 and row["support_rows"] == 6
    assert aggregate["episode_count"] == 1 and aggregate["total_refreshes"] == 1 and aggregate["planned_episode_count"] == 1
    assert spark.read.parquet(f"file://{tmp_path}/bursts").count() == 6 and spark.read.parquet(f"file://{tmp_path}/stages").count() == 3 * test.count()
    assert state.read_json(spark, f"file://{tmp_path}/state/episode=0")["calibration_mode"] == "ensemble"
    assert config.policy(True) != config.policy(False)
    with pytest.raises(ValueError):
        TinyConfig(members=0)


def test_runs_from_files_sweep_and_go_on(spark, tmp_path):
    train, held, test = planted(spark, 3, 40)
    for name, df in (("train", train), ("calibration", held), ("test", test)):
        df.write.parquet(f"file://{tmp_path}/{name}")
    (tmp_path / "m.json").write_text(json.dumps({"name": "x", "splits": {n: n for n in ("train", "calibration", "test")}}))
    given = {"name": "A b!", "manifest": "m.json", "output": "out", "experiment": {"base_ratio": 0.7, "model": {"scaler": "standard", "map_kind": "identity", "scale_mode": "absolute", "projection": "pca", "projection_width": 4, "penalty": ["log", 0.2]}}, "data": {"aliases": ["y", "y", "z"], "numeric": ["f0"]}}
    (tmp_path / "run.json").write_text(json.dumps(given, indent=1))
    run = configs.load_run(spark, f"file://{tmp_path}/run.json")
    assert run.experiment.model.penalty == ("log", 0.2) and run.data.aliases == ("y", "z") and run.data.candidates[:3] == ("label", "y", "z")
    out = f"file://{tmp_path}/out"
    runner.main([f"file://{tmp_path}/run.json", "--seeds", "42"])
    assert runner.sweep_log(spark, out).count() == 1
    broken = train.withColumn("f0", F.raise_error(F.lit("no such disk")).cast("double"))
    cells = {"A b!/own/42": (train, held, test, run.experiment), "bad": (train, held.where("false"), test, run.experiment), "broken": (broken, held, test, run.experiment)}
    done = runner.run_sweep(cells, out, spark)
    assert [r["tag"] for r in done.collect()] == ["A b!/own/42"]
    told = {r["tag"]: (r["status"], r["error"]) for r in runner.sweep_log(spark, out).collect()}
    assert told["bad"][0] == told["broken"][0] == "failed" and "no such disk" in told["broken"][1] and len(told) == 3
    assert runner.summary(done).first()["seeds"] == 1 and spark.read.parquet(f"{out}/summary").count() == 1
    (tmp_path / "bad.json").write_text(json.dumps({"name": "x", "experiment": {"model": {"no": 1}}}))
    with pytest.raises(ValueError, match="has no"):
        configs.load_run(spark, f"file://{tmp_path}/bad.json")
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        configs.read_mapping(spark, f"file://{tmp_path}/list.json")
    (tmp_path / "r.yaml").write_text("name: y\nexperiment:\n  shots: 3\n")
    pytest.importorskip("yaml")
    assert configs.load_run(spark, f"file://{tmp_path}/r.yaml").experiment.shots == 3


def test_names_lists_and_ids(spark):
    at = datetime(2024, 1, 2, 3, 4, 5, 6, tzinfo=UTC)
    assert configs.run_id("My Run: #1!", at) == "20240102-030405-my-run-1" and configs.run_id("!!", at).endswith("-run") and configs.stamp(at) == "2024-01-02T03:04:05Z"
    assert configs.unique(["b", "a", "b"]) == ["b", "a"] and configs.unique(None) == []
    with pytest.raises(TypeError):
        configs.unique("ab")
    with pytest.raises(ValueError, match="both name"):
        configs.DataConfig(numeric=("a",), categorical=("a",))
    df = tables.with_ids(spark.createDataFrame([(1, "x")], "score int, novel string"), episode=3, novel=None)
    assert df.columns == ["episode", "novel", "score"] and df.first()["novel"] == ""


def test_a_run_folder_scores_as_the_run_did(spark, tmp_path):
    train, held, test = planted(spark, 4, 40)
    config = ExperimentConfig(FAST, base_ratio=0.75, class_seed=1)
    _, scored = runner.run_sessions(train, held, test, config, f"file://{tmp_path}")
    run = state.read_json(spark, f"file://{tmp_path}/run")
    again = tables.run_scores(spark, f"file://{tmp_path}", run["base"], run["novel"])
    assert told(again.orderBy("session_id")) == told(scored)
    assert spark.read.json(f"file://{tmp_path}/metrics/session_0").first()["session_id"] == 0
