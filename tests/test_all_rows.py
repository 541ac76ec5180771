"""Fits on all rows: power exponents, landmarks, leverages."""

import numpy as np
import pytest

from lodestar.operators import admission, maps, preprocess


def test_power_exponent_is_of_all_rows(spark):
    hot = spark.range(150_000).selectExpr("1.0 AS v").unionByName(spark.range(150_000).selectExpr("exp(3 * (id % 1000) / 1000) AS v"))
    fitted = preprocess.fit(hot, preprocess.infer_schema(hot, "none"), "power")
    x = np.concatenate([np.ones(150_000), np.tile(np.exp(3 * np.arange(1000) / 1000), 150)])
    logs = np.log1p(x).sum()
    lams = np.linspace(-4, 6, 2001)
    cost = [len(x) / 2 * np.log(preprocess.power(x, lam).var()) - (lam - 1) * logs for lam in lams]
    assert fitted.lam["v"] == pytest.approx(lams[int(np.argmin(cost))], abs=0.006)


def test_rare_class_keeps_its_landmark(spark):
    rows = spark.range(30_001).selectExpr("id AS row_id", "IF(id = 17, 'rare', 'common') AS label", "array(IF(id = 17, 100D, rand(1)), 0D) AS x").cache()
    marks = maps.supervised_landmarks(rows, 4)
    assert marks.shape == (4, 2) and (marks[:, 0] == 100).sum() == 1
    others = maps.supervised_landmarks(rows, 4, seed=3)
    assert (others[:, 0] == 100).sum() == 1


def test_high_leverage_row_is_kept_wherever_it_stands(spark):
    rows = spark.range(1001).selectExpr("'a' AS unit", "id AS seq", "array(IF(id = 333, 1e6, 0D) + 1e-3 * sin(id), cos(id)) AS phi").cache()
    for seed in range(4):
        kept = {r["seq"] for r in admission.trim(rows, ["unit"], 10, "leverage", seed=seed).collect()}
        assert len(kept) == 10 and 333 in kept
