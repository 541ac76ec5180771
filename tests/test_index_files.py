"""Indexes leave no intermediate tables behind."""

from pathlib import Path

import numpy as np

from lodestar.functions.session import shared_dir
from lodestar.operators import graph, prototypes


def size(spark):
    return sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file://")).rglob("*") if f.is_file())


def test_neighbours_keep_edges_and_not_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 40))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "row_id long, label string, x array<double>")
    before = size(spark)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2)) + np.diag(np.full(600, np.inf))
    assert abs(prototypes.median_nearest(df) - np.median(d.min(1))) < 1e-9
    assert size(spark) == before
    assert graph.localise(df, 3, 2).count() == 600
    assert size(spark) - before < 600 * 40 * 8
