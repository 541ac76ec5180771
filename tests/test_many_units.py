"""A bank of more units than reach the driver."""

import numpy as np
import pytest

from lodestar.operators import prototypes
from lodestar.operators.prototypes import Bank
from lodestar.plans import model as models
from lodestar.plans.config import ModelConfig


def some_units(spark, n, seed=3, width=3):
    rng = np.random.default_rng(seed)
    rows = [(i, f"c{i % 4 % 3}", (np.array([i // 2 % 97, i // 2 % 13, 0.0]) + rng.normal(scale=1e-3, size=width)).tolist()) for i in range(2 * n)]
    return spark.createDataFrame(rows, "seq long, label string, phi array<double>").selectExpr("concat(label, ':', seq div 4) AS unit_id", "label", "seq", "1.0D AS w", "0.0D AS t", "phi")


def test_a_fit_takes_more_units_than_the_driver(spark):
    support = spark.range(prototypes.MAX_PROTOTYPES + 1).selectExpr("concat('u', id) AS unit_id", "'c' AS label")
    models.check_budgets(support, ModelConfig())


@pytest.mark.parametrize("cap", [3, 40])
def test_capped_in_tasks_equals_capped_on_the_driver(spark, cap):
    made = prototypes.build(some_units(spark, 200), vector="phi", weight="w", second=True).localCheckpoint()
    want = prototypes.capped(Bank.of(made), cap)
    got = Bank.of(prototypes.capped_table(made, cap))
    assert got.ids == want.ids and got.labels == want.labels and got.status == want.status and len(got.ids) <= max(cap, 3)
    for name in ("centers", "rho", "weight", "cov", "rows"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name


@pytest.mark.parametrize("changes", [{}, {"squeeze": 0.2, "shrink": 0.3, "dual": 0.5}])
def test_the_bank_is_the_same_from_the_table(spark, monkeypatch, changes):
    support = some_units(spark, 120).localCheckpoint()
    config = ModelConfig(projection_width=2, bank_cap=30, **changes)
    projection = models.projected(models.ledger_of(support, config), config)
    want, scales, _ = models.bank_of(support, projection, config, 1.0)
    monkeypatch.setattr(prototypes, "MAX_PROTOTYPES", 50)
    assert support.select("unit_id").distinct().count() > 50
    got, found, _ = models.bank_of(support, projection, config, 1.0)
    assert got.ids == want.ids and got.labels == want.labels and len(got.ids) == 30
    assert np.allclose([*vars(found).values()], [*vars(scales).values()], rtol=1e-12)
    for name in ("centers", "rho", "weight", "cov", "wide", "wide_rho"):
        a, b = getattr(got, name), getattr(want, name)
        assert a is None and b is None or np.allclose(a, b, rtol=1e-9, atol=1e-12), name
