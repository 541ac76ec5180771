"""Versions that change whole: models, buffers, logs; killed and rival writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators.prototypes import Bank
from lodestar.plans import model as models
from lodestar.plans import state
from lodestar.sources.commits import Conflict, Versions
from lodestar.streaming.buffer import Buffer
from tests.test_model import SMALL, planted

FAST = SMALL.with_(map_kind="identity", scale_mode="absolute", projection="pca", projection_width=4)


class Killed(BaseException):
    """Not an error that a writer handles: as if its process had ended."""


def test_versions_follow_each_other_and_rivals_are_told(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    assert v.latest() is None and v.history() == [] and v.clean() == []
    with v.begin() as first:
        spark.range(3).write.parquet(f"{first.data}/rows")
        first.info["n"] = 3
    assert (v.latest().version, v.latest().info) == (0, {"n": 3})
    one, two = v.begin(), v.begin()
    spark.range(5).write.parquet(f"{two.data}/rows")
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert not (tmp_path / "t" / "data" / two.token).exists() and v.names("intents") == []
    with pytest.raises(ZeroDivisionError), v.begin() as third:
        spark.range(1).write.parquet(f"{third.data}/rows")
        raise ZeroDivisionError
    assert v.latest().version == 1 and v.names("intents") == []
    calls = []

    def change(latest, made):
        calls.append(latest.version)
        if len(calls) == 1:
            v.record({"rival": True})

    assert v.update(change).version == 3 and calls == [1, 2]
    assert [c.info for c in v.history()] == [{"n": 3}, {}, {"rival": True}, {}]


def test_a_save_killed_between_two_tables_leaves_the_former_model(spark, tmp_path, monkeypatch):
    train, held, test = planted(spark, 3, 40)
    model = models.fit(train, held, FAST.with_(mode="knn", knn=3))
    folder = f"file://{tmp_path}/m"
    assert state.save(model, folder) == 0
    before = sorted(map(str, models.predict(state.load(spark, folder), test).collect()))
    assert state.load(spark, folder).index is not None
    changed = models.replace(model, tau=0.0)

    def dies(*args):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(state, "write_json", dies)
        with pytest.raises(Killed):
            state.save(changed, folder)
    again = state.load(spark, folder)
    assert sorted(map(str, models.predict(again, test).collect())) == before
    left = Versions(spark, folder)
    assert len(left.names("data")) == 2 and len(left.names("intents")) == 1
    assert len(left.clean(abandoned=0)) == 1 and len(left.names("data")) == 1
    # A loaded model may be saved where it came from, and replaces it.
    assert state.save(models.replace(again, tau=0.0), folder) == 1
    assert state.load(spark, folder).tau == 0.0 and len(left.names("data")) == 1


def test_labels_called_number_survive(spark, tmp_path):
    given = {"number": 0.7, "nan": float("nan"), "list": [1.0, float("inf")], "texts": ["number", "x"]}
    again = state.back(json.loads(json.dumps(state.plain({"by_class": {"number": 0.7}, **given}))))
    assert again["by_class"] == {"number": 0.7} and np.isnan(again["nan"]) and again["list"] == [1.0, float("inf")] and again["texts"] == ["number", "x"]


def test_a_buffer_is_rescored_written_capped_and_cleaned(spark, tmp_path):
    schema = "seq long, value double, accepted boolean"
    rows = lambda *seqs: spark.createDataFrame([(s, float(s), False) for s in seqs], schema)
    buffer = Buffer(spark, f"file://{tmp_path}/b", schema, 6)
    for batch in range(20):
        buffer.add(rows(2 * batch, 2 * batch + 1), batch)
    assert sorted(r["seq"] for r in buffer.read().collect()) == list(range(34, 40))
    assert len(buffer.versions.names("data")) == 2 == len(buffer.versions.known())
    buffer.add(rows(99), 19)  # a repeated batch
    assert buffer.read().agg(F.max("seq")).first()[0] == 39
    buffer.most = 3
    kept, left = buffer.rescore(lambda df: df.withColumn("accepted", F.col("value") == 38), version=7)
    assert left == 1 and sorted(r["seq"] for r in buffer.read().collect()) == [36, 37, 39] == sorted(r["seq"] for r in kept.collect())
    assert buffer.versions.latest().info == {"batch": 19, "model": 7}
    buffer.add(rows(50), 20)
    assert sorted(r["seq"] for r in buffer.read().collect()) == [37, 39, 50]


def test_support_rows_do_not_vote_for_themselves(spark):
    train, held, _ = planted(spark, 3, 30)
    model = models.fit(train, held, FAST.with_(mode="knn", knn=1))
    z = models.cut(models.project(model.support.select(F.col("seq").alias("row_id"), "label", "phi", F.lit(True).alias("own")), model.projection.matrix).drop("phi"))
    scores = [r["score"] for r in models.vote_scores(model, z).collect()]
    assert len(scores) == model.support.count() and min(scores) > 0
    assert max(r["score"] for r in models.vote_scores(model, z.drop("own")).collect()) == 0
    assert isinstance(model.bank, Bank)
