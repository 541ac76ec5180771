"""Moments kept up by changes, support that is read by class, members in one scan, scopes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.session import cut, scope
from lodestar.operators.ledger import Ledger
from lodestar.plans import model as models
from lodestar.plans import runner
from lodestar.plans.config import ExperimentConfig, TinyConfig
from tests.test_model import SMALL, planted

FAST = SMALL.with_(map_kind="identity", scale_mode="absolute", projection="soft_null", projection_width=4)


@pytest.fixture(scope="module")
def fitted(spark):
    train, held, test = planted(spark, 4, 60)
    base = lambda df: df.where("label <> 'c03'")
    return models.fit(base(train), base(held), FAST), train, test


def same(a, b):
    return a.n == pytest.approx(b.n) and all(np.allclose(x, y, rtol=1e-9, atol=1e-8) for x, y in ((a.s1, b.s1), (a.s2, b.s2), (a.between, b.between)))


def test_a_refresh_changes_the_moments_of_touched_classes_only(fitted, monkeypatch):
    model, train, _ = fitted
    assert same(model.ledger, Ledger.of(model.support))
    read = []
    whole = Ledger.of
    monkeypatch.setattr(Ledger, "of", staticmethod(lambda rows, *a: read.append(sorted(r[0] for r in rows.select("label").distinct().collect())) or whole(rows, *a)))
    new = models.refresh(model, train.where("label = 'c03'").limit(30), now=1.0, force=("c03",))
    assert read == [[], ["c03"]] and new.ledger.changes == 1
    again = models.refresh(new, train.where("label = 'c01'").limit(9), now=2.0, force=("c01",))
    assert read[2:] == [["c01"], ["c01"]]
    monkeypatch.undo()
    assert same(again.ledger, Ledger.of(again.support))
    full = models.projected(Ledger.of(again.support), again.config, new.projection)
    assert np.allclose(full.spectrum, again.projection.spectrum) and np.allclose(full.matrix @ full.matrix.T, again.projection.matrix @ again.projection.matrix.T, atol=1e-6)
    assert same(models.archive_class(again, "c00").ledger, Ledger.of(again.support.where("label <> 'c00'")))


def test_support_is_filtered_where_it_is_stored(fitted):
    model, *_ = fitted
    plan = model.support.where(F.col("label").isin(["c01"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,c01)]" in plan or "In(label" in plan


def test_all_members_predict_in_one_scan(spark, fitted):
    model, train, test = fitted
    other = models.replace(model, tau=model.tau / 2, version=3)
    both = models.predict_members([model, other], test, keep=("label",))
    assert both._jdf.queryExecution().analyzed().collectLeaves().size() == test._jdf.queryExecution().analyzed().collectLeaves().size()
    for i, m in enumerate((model, other)):
        one = models.predict(m, test, keep=("label",))
        assert sorted(map(str, both.where(F.col("member") == i).select(*one.columns).collect())) == sorted(map(str, one.collect()))
    found = runner.predict_members([model, other], test, "average", ("label",))
    assert found.count() == test.count() and "label" in found.columns


def test_members_are_fitted_side_by_side(spark):
    train, held, _ = planted(spark, 3, 30)
    config = TinyConfig(ExperimentConfig(FAST), bursts=(2,), episodes=1, members=2)
    one, two = runner.fit_members(train, held, config)
    assert two.config.seed == one.config.seed + config.seed_step and one.classes == two.classes


def test_scopes_remove_what_they_wrote_unless_it_is_kept(spark):
    with scope(spark) as own:
        gone, kept = cut(spark.range(5)), cut(spark.range(7))
        built = kept.withColumn("x", F.lit(1))
        own.keep(built)
        inner = [x for x in own.made]
    exists = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(name))
    assert len(inner) == 2 and sum(map(exists, inner)) == 1 and built.count() == 7
    with pytest.raises(ValueError), scope(spark) as own:
        cut(spark.range(3))
        made = list(own.made)
        own.keep(gone)
        raise ValueError
    assert not any(map(exists, made))


def test_a_fit_leaves_only_what_the_model_reads(spark):
    train, held, _ = planted(spark, 3, 30)
    with scope(spark) as own:
        model = models.fit(train, held, FAST)
        assert len(own.made) == 2 and model.support.count() > 0 and model.held.count() > 0
        own.keep(model.support, model.held)
    assert model.support.count() > 0
