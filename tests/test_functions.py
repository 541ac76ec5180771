import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import labels, statistics
from lodestar.operators import maps, preprocess, scoring
from lodestar.operators.splits import plan_sessions


@pytest.mark.parametrize(("given", "loader", "preparer"), [(" DoS-Hulk ", "dos_hulk", "dos_hulk"), ("Web Attack / XSS", "web_attack_xss", "web_attack_/_xss"), (None, "unknown", None), ("--", "unknown", "__")])
def test_label_forms(spark, given, loader, preparer):
    row = spark.createDataFrame([(given,)], "x string").select(labels.normalized(F.col("x")), labels.prepared(F.col("x"))).first()
    assert (row[0], row[1]) == (loader, preparer)


def test_headers_and_label_column():
    assert labels.clean_header("﻿ a ") == "a"
    assert labels.label_column(["x", "Type", "LABEL"]) == "LABEL"
    with pytest.raises(KeyError):
        labels.label_column(["x"])


def test_weibull_and_pareto_recover_their_parameters():
    rng = np.random.default_rng(1)
    shape, scale = statistics.weibull_fit(2.0 * rng.weibull(3.0, 20_000))
    assert abs(shape - 3) < 0.1 and abs(scale - 2) < 0.05
    xi, sigma = 0.2, 1.5
    draws = sigma / xi * ((1 - rng.random(20_000)) ** -xi - 1)
    shape, scale = statistics.pareto_fit(draws)
    assert abs(shape - xi) < 0.05 and abs(scale - sigma) < 0.1
    assert statistics.pareto_quantile(0.5, 0.0, 1.0) == pytest.approx(math.log(2))


def test_chi_square_and_student_tails():
    assert scoring.chi2_sf(np.array([3.841458820694124]), 1)[0] == pytest.approx(0.05, abs=1e-9)
    assert scoring.chi2_sf(np.array([7.814727903251179]), 3)[0] == pytest.approx(0.05, abs=1e-9)
    assert scoring.chi2_sf(np.array([18.307038053275146]), 10)[0] == pytest.approx(0.05, abs=1e-9)
    assert statistics.student_two_sided(2.2621571627409915, 9) == pytest.approx(0.05, abs=1e-9)


def test_projection_is_orthonormal_and_prefers_quiet_directions():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 6)) * [5, 5, 5, 0.1, 5, 5]
    within = (x - x.mean(0)).T @ (x - x.mean(0))
    total = within + 100 * np.eye(6)
    found = maps.soft_null(total, within, 2)
    assert np.allclose(found.matrix.T @ found.matrix, np.eye(found.matrix.shape[1]), atol=1e-8)
    assert abs(found.matrix[3, 0]) > 0.99
    warm = maps.warm_start(found.matrix, np.eye(6)[:, : found.matrix.shape[1]], 0.3)
    assert np.allclose(warm.T @ warm, np.eye(warm.shape[1]), atol=1e-8)


def test_landmarks_are_shared_out_wholly():
    assert maps.landmark_allocation({"a": 10, "b": 1}, 1) == {"a": 1, "b": 0}
    assert sum(maps.landmark_allocation({"a": 7, "b": 5, "c": 3}, 11).values()) == 11


def test_map_state_survives_saving():
    made = maps.fit("rff", 4, 8, 0.5, 3)
    x = np.random.default_rng(0).standard_normal((3, 4))
    assert np.allclose(maps.Map.load(made.save())(x), made(x))
    with pytest.raises(ValueError):
        made(np.zeros((1, 5)))


def test_sessions_keep_one_class_on_each_side():
    assert plan_sessions(["a", "b"], 0.01) == (["a"], ["b"])
    assert plan_sessions(["a", "b", "c"], 0.99) == (["a", "b"], ["c"])
    with pytest.raises(ValueError):
        plan_sessions(["a"], 0.5)


def test_preprocessing_handles_drift_nulls_and_new_categories(spark):
    train = spark.createDataFrame([("a", 1.0, "x"), ("b", None, "y"), ("a", 3.0, "x"), ("b", 9.0, None)], "label string, n double, c string")
    schema = preprocess.infer_schema(train, "label")
    assert (schema.numeric, schema.categorical) == (("n",), ("c",))
    with pytest.raises(ValueError):
        preprocess.infer_schema(train, "label", ("n",), ("n",))
    for scaler in preprocess.SCALERS:
        fitted = preprocess.fit(train, schema, scaler)
        new = spark.createDataFrame([("z", "q", float("inf"))], "extra string, c string, n double")
        aligned, drift = preprocess.align(new, schema)
        assert drift.extra == ("extra",) and not drift.missing and aligned.columns == ["n", "c"]
        x = preprocess.transform(new, fitted).first()["x"]
        assert len(x) == len(fitted.names) == 3 and x[1:] == [0.0, 0.0] and all(map(math.isfinite, x))
        assert len(preprocess.transform(train.drop("n"), fitted).first()["x"]) == 3


def test_energy_is_a_soft_minimum():
    d = np.array([[1.0, 2.0, 3.0]])
    assert scoring.softmin(d, 0.01)[0] == pytest.approx(1.0, abs=1e-3)
    assert scoring.softmin(d, 1.0)[0] < 1.0


def test_signed_rank_and_paired_t():
    a = np.array([1.1, 2.3, 3.2, 4.8, 5.9, 7.1, 8.4, 9.2, 10.6, 11.9])
    assert statistics.wilcoxon(a, a - np.arange(1, 11)) == pytest.approx(2 / 2**10)
    assert statistics.wilcoxon(a, a) == 1.0 and statistics.wilcoxon(a, a - 1) < 0.01
    t, p = statistics.paired_t(a, a - np.arange(1, 11) / 10)
    assert t == pytest.approx(5.744563, abs=1e-5) and p == pytest.approx(0.000278, abs=1e-5)
    assert statistics.paired_t(a, a) == (0.0, 1.0)
