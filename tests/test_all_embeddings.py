"""Queries without SQL read all of embeddings."""

from lodestar.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_nystrom_maps_every_row(spark):
    assert QUERIES["nystrom"](spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_classes_are_filled_to_the_largest(spark):
    sizes = {str(r["label"]): r["count"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect()}
    drawn = {r["label"]: r["drawn"] for r in QUERIES["pa_inn"](spark, SF).collect()}
    assert drawn == {c: max(sizes.values()) - n for c, n in sizes.items() if n < max(sizes.values())}


def test_draws_have_the_moments_of_their_class(spark):
    import numpy as np

    from lodestar.plans.model import _augmented

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) @ np.array([[2.0, 0, 0], [1, 1, 0], [0, 0.5, 0.1]]) + [5, -3, 100]
    rows = [(i, "few", v.tolist()) for i, v in enumerate(x)] + [(1000, "one", [1.0, 2.0, 3.0])] + [(2000 + i, "full", [0.0, 0.0, float(i)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_id long, label string, phi array<double>").repartition(3)
    made = _augmented(df, 6000, 7).collect()
    few = np.array([r["phi"] for r in made if r["label"] == "few"])
    assert len(few) == 5600 and len({r["row_id"] for r in made}) == len(made) == 5600 + 5999 and max(r["row_id"] for r in made) < 0
    assert np.allclose(few.mean(0), x.mean(0), atol=0.2) and np.allclose(np.cov(few.T), np.cov(x.T), atol=0.4)
    assert np.allclose([r["phi"] for r in made if r["label"] == "one"], [1, 2, 3], atol=0.01)
    assert sorted(map(str, made)) == sorted(map(str, _augmented(df.repartition(5), 6000, 7).collect()))
