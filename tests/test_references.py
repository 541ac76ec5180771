"""Reference rows and admitted rows are all taken."""

from types import SimpleNamespace

import pytest

from lodestar.operators import scoring
from lodestar.plans import model


@pytest.mark.parametrize("chunk", [1, 7, 8192])
def test_neighbours_come_from_all_chunks(spark, chunk):
    refs = spark.createDataFrame([(i, str(i // 20), [float(i), 0.0]) for i in range(40)], "row_id long, label string, x array<double>")
    rows = spark.createDataFrame([(1, [39.0, 0.0]), (2, [19.5, 0.0])], "row_id long, x array<double>")
    near = scoring.nearest_references(rows, refs, 3, chunk=chunk)
    assert sorted((r["row_id"], r["ref"]) for r in near.collect()) == [(1, 37), (1, 38), (1, 39), (2, 18), (2, 19), (2, 20)]
    assert sorted(tuple(r) for r in scoring.knn_vote(near).collect()) == [(1, "1", 2.0), (2, "0", 1.5)]


def test_vote_reads_reference_rows_over_the_former_cap(spark):
    refs = spark.range(20_100).selectExpr("id AS row_id", "IF(id < 20000, 'a', 'b') AS label", "array(CAST(id AS DOUBLE)) AS x")
    rows = spark.createDataFrame([(1, [20_050.0])], "row_id long, x array<double>")
    assert tuple(scoring.knn_vote(scoring.nearest_references(rows, refs, 5)).first()) == (1, "b", 2.0)


def test_too_many_admitted_rows_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(model, "MAX_ADMITTED", 3)
    monkeypatch.setattr(model, "support_rows", lambda m, df, label, key: df)
    rows = spark.createDataFrame([(i, "a", [0.0]) for i in range(4)], "row_id long, label string, phi array<double>")
    with pytest.raises(ValueError, match="over 3 rows"):
        model.admit(SimpleNamespace(), rows)
