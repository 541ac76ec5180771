"""Covariance queries at full width against numpy."""

import numpy as np
import pytest

from lodestar.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    found = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in found]), np.array([str(r["label"]) for r in found]), np.array([r["embedding"] for r in found], float)


def within_of(labels, x):
    return sum((x[labels == c] - x[labels == c].mean(0)).T @ (x[labels == c] - x[labels == c].mean(0)) for c in sorted(set(labels)))


def test_whitened_rows_have_no_scatter_between_coordinates(spark, rows):
    ids, labels, x = rows
    found = {r["row_id"]: r["white"] for r in QUERIES["whitening_all_coordinates"](spark, SF).collect()}
    white = np.array([found[i] for i in ids])
    values, axes = np.linalg.eigh(within_of(labels, x) / len(x))
    assert np.allclose(white, x @ axes @ np.diag(1 / np.sqrt(np.maximum(values, 1e-10))) @ axes.T, atol=1e-4 * np.abs(white).max())


def test_directions_of_least_scatter(spark, rows):
    _, labels, x = rows
    within = within_of(labels, x)
    found = QUERIES["soft_null_all_coordinates"](spark, SF).orderBy("i").collect()
    total = (x - x.mean(0)).T @ (x - x.mean(0))
    values, axes = np.linalg.eigh(total)
    basis = axes[:, values > 1e-8 * values[-1]]
    least = np.linalg.eigvalsh(basis.T @ within @ basis)[:8]
    assert np.allclose([r["scatter"] for r in found], least, atol=1e-6 * least[-1])
    for r in found:
        axis = np.array(r["axis"])
        assert axis @ within @ axis == pytest.approx(r["scatter"], abs=1e-6 * least[-1]) and axis @ axis == pytest.approx(1)


@pytest.mark.parametrize("relative", [False, True])
def test_distances_under_whole_covariances(spark, rows, relative):
    ids, labels, x = rows
    base = sorted(c for c in set(labels) if c < "7")
    own = {c: x[labels == c] for c in base}
    n = {c: len(v) for c, v in own.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    pooled = sum(n[c] * cov[c] for c in base) / sum(n.values())
    d = x.shape[1]
    if relative:
        known = np.isin(labels, base)
        inverse = {c: np.linalg.inv(pooled + 1e-6 * np.eye(d)) for c in base}
        away = x - x[known].mean(0)
        behind = np.sqrt(np.einsum("nd,de,ne->n", away, inverse[base[0]], away))
    else:
        diagonal = np.diag(np.diag(pooled))
        inverse = {c: np.linalg.inv((n[c] * cov[c] + d * diagonal) / (n[c] + d) + 1e-10 * np.eye(d)) for c in base}
        behind = 0.0
    far = np.stack([np.sqrt(np.einsum("nd,de,ne->n", x - own[c].mean(0), inverse[c], x - own[c].mean(0))) for c in base], 1)
    name = "score_relative_mahalanobis_all_coordinates" if relative else "score_mahalanobis_all_coordinates"
    found = {r["row_id"]: (r["label"], r["score"]) for r in QUERIES[name](spark, SF).collect()}
    assert np.allclose([found[i][1] for i in ids], far.min(1) - behind, rtol=1e-5, atol=1e-4)
    assert [found[i][0] for i in ids] == [base[j] for j in far.argmin(1)]
