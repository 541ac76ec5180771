"""Every scoring mode is fitted, calibrated by its own score, and predicts."""

import numpy as np
import pytest

from lodestar.operators import prototypes, scoring
from lodestar.operators.scoring import MODES
from lodestar.plans import model as models
from lodestar.plans.config import ModelConfig
from tests.test_model import SMALL, planted


def test_a_mode_that_does_not_exist_is_an_error():
    assert set(MODES) == {m for m in MODES if ModelConfig(mode=m).mode == m}
    with pytest.raises(ValueError, match="mode is one of"):
        ModelConfig(mode="nonsense")


@pytest.fixture(scope="module")
def base(spark):
    train, held, test = planted(spark, 4, 80)
    seen = lambda df: df.where("label <> 'c03'")
    quick = SMALL.with_(projection="pca", projection_width=8, tie_break=None, scale_mode="absolute", fragile_below=40.0)
    return models.fit(seen(train), seen(held), quick), test.cache()


@pytest.mark.parametrize("change", [*({"mode": m} for m in MODES), {"dual": 0.6}, {"mode": "energy", "class_temperature": 0.5}, {"teen": (0.3, 0.1, 3), "squeeze": 0.05, "shrink": 0.1}], ids=str)
def test_modes_fit_and_tell_classes_apart(base, change):
    fitted, test = models.rescored(base[0], **change), base[1]
    rows = models.predict(fitted, test, keep=("label",)).collect()
    assert len(rows) == test.count() and np.isfinite(fitted.tau) and all(np.isfinite(r["score"]) for r in rows)
    known = [r for r in rows if r["label"] != "c03"]
    assert np.mean([r["best_class_label"] == r["label"] for r in known]) > 0.9


def plain_covariance(z):
    away = z - z.mean(0)
    return away.T @ away / len(z)


def test_precisions_and_background_equal_plain_numpy(spark):
    rng = np.random.default_rng(5)
    parts = {"a": rng.standard_normal((30, 3)) * [1, 2, 3], "b": rng.standard_normal((9, 3)) + 4, "c": rng.standard_normal((1, 3))}
    rows = [(f"u{k}", k, x.tolist()) for k, xs in parts.items() for x in xs]
    df = spark.createDataFrame(rows, "unit_id string, label string, x array<double>").repartition(5)
    bank = prototypes.Bank.of(prototypes.build(df, second=True))
    covs = [plain_covariance(parts[k]) for k in bank.labels]
    n = np.array([len(parts[k]) for k in bank.labels])
    assert np.allclose(bank.cov, covs)
    shared = np.diag(np.diag(sum(k * c for k, c in zip(n, covs, strict=True)) / n.sum()))
    want = [np.linalg.inv(k / (k + 3) * c + 3 / (k + 3) * shared + 1e-10 * np.eye(3)) for k, c in zip(n, covs, strict=True)]
    assert np.allclose(prototypes.precisions(bank), want, rtol=1e-6)
    assert np.allclose(prototypes.diagonal_precisions(bank)[:2], [1 / np.diag(c) for c in covs[:2]]) and (prototypes.diagonal_precisions(bank)[2] == 1).all()
    mean, inverse = prototypes.background(df)
    assert np.allclose(mean, np.vstack(list(parts.values())).mean(0))
    assert np.allclose(inverse, np.linalg.inv(sum(k * c for k, c in zip(n, covs, strict=True)) / n.sum() + 1e-6 * np.eye(3)), rtol=1e-5)
    x = rng.standard_normal((7, 3))
    score, at, _ = scoring.evaluate(x, bank, scoring.Rule("relative_mahalanobis", precision=inverse, background=(mean, inverse)))
    own = [[np.sqrt((r - c) @ inverse @ (r - c)) for c in bank.centers] for r in x]
    assert np.allclose(score, [min(o) - np.sqrt((r - mean) @ inverse @ (r - mean)) for o, r in zip(own, x, strict=True)])


def test_merging_keeps_the_covariance_of_all_rows(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.standard_normal((12, 2)), rng.standard_normal((5, 2)) + 1])
    rows = [("u" + "ab"[i >= 12], "k", r.tolist()) for i, r in enumerate(x)]
    bank = prototypes.Bank.of(prototypes.build(spark.createDataFrame(rows, "unit_id string, label string, x array<double>"), second=True))
    one = prototypes.capped(bank, 1)
    assert np.allclose(one.centers[0], x.mean(0)) and np.allclose(one.cov[0], plain_covariance(x)) and one.weight[0] == 17


def test_calibration_uses_the_score_of_the_mode(base):
    fitted = models.rescored(base[0], mode="mahalanobis")
    z = models.project(fitted.held, fitted.projection.matrix)
    found = models.calibration_scores(z, fitted.bank, rule=fitted.rule()).where("kind = 'pos'").collect()
    rows = {r["row_id"]: r for r in z.collect()}
    inverse = prototypes.precisions(fitted.bank)
    for r in found[:20]:
        x = np.array(rows[r["seq"]]["z"])
        own = [np.sqrt((x - c) @ p @ (x - c)) for c, p, label in zip(fitted.bank.centers, inverse, fitted.bank.labels, strict=True) if label == r["label"]]
        assert r["score"] == pytest.approx(min(own))
