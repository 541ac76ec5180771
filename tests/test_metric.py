"""Neighbours by the metric index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.session import cut
from lodestar.operators import graph, metric, scoring


def brute(ids, of, x, r):
    out = {}
    for i in range(len(ids)):
        order = sorted((((x[i] - x[j]) ** 2).sum(), ids[j]) for j in range(len(ids)) if ids[j] != ids[i] and of[j] == of[i])
        out[ids[i]] = [k for _, k in order[:r]]
    return out


def lists(edges):
    out = {}
    for e in edges.collect():
        out.setdefault(e["src"], []).append((e["rank"], e["dst"]))
    return {k: [d for _, d in sorted(v)] for k, v in out.items()}


def frame(spark, ids, of, x):
    return spark.createDataFrame([(int(i), o, v.tolist()) for i, o, v in zip(ids, of, x, strict=True)], "row_id long, label string, x array<double>")


def clusters(rng, n, width=6):
    centers = rng.normal(size=(max(4, n // 60), width)) * 50
    return centers[rng.integers(len(centers), size=n)] + rng.normal(size=(n, width))


@pytest.mark.parametrize("r", [1, 5])
def test_five_hundred_equal_rows_in_three_layouts(spark, r):
    rng = np.random.default_rng(0)
    x = np.vstack([np.zeros((500, 3)), np.repeat(np.eye(3), 20, 0), np.round(rng.normal(size=(300, 3)), 0)])
    ids = rng.permutation(len(x))
    of = ["a"] * len(x)
    expected = brute(ids, of, x, r)
    for parts in (1, 3, 7):
        df = frame(spark, ids, of, x).orderBy(F.xxhash64("row_id", F.lit(parts))).repartition(parts)
        assert lists(graph.nearest(df, r, chunk=40)) == expected


def test_classes_nulls_and_cells(spark):
    rng = np.random.default_rng(1)
    x = clusters(rng, 900)
    of = np.where(np.arange(900) % 3 == 0, "b", np.where(np.arange(900) % 31 == 0, "one", "a")).tolist()
    of[5], of[10] = None, None
    df = frame(spark, range(900), of, x)
    for chunk in (8, 4096):
        assert lists(graph.nearest(df, 4, chunk=chunk)) == {k: v for k, v in brute(list(range(900)), of, x, 4).items() if v}
    labels = {r["label"] for r in graph.nearest(df, 1).select("label").distinct().collect()}
    assert labels == {"a", "b", "one", None}
    assert graph.nearest(df.limit(0), 3).count() == 0
    assert graph.nearest(df.withColumn("x", F.when(F.col("row_id") < 40, F.col("x"))), 3).select("src").distinct().count() <= 40


def test_few_rows_travel_on_clustered_data(spark):
    """Forwarded queries, the only rows that travel more than once."""
    rng = np.random.default_rng(2)
    sent = {}
    for n in (2000, 8000):
        rows = cut(metric.marked(frame(spark, range(n), [""] * n, clusters(rng, n)).select(F.lit("").alias("of"), F.lit(None).cast("string").alias("label"), F.col("row_id").alias("id"), F.col("x").alias("v"))))
        index = metric.build(rows, 6, 128)
        upper = spark.sparkContext.broadcast(index.cells)
        first = index.members.withColumn("far", F.lit(None).cast("double")).groupBy("ball").applyInArrow(metric._meeting(6, upper, True, True), metric.FIRST)
        sent[n] = n + first.agg(F.sum(F.size("visits"))).first()[0]
        assert index.members.agg(F.max("ball")).first()[0] >= n // 256
    assert sent[8000] < 8000**1.5 / 4 and sent[8000] / sent[2000] < 4**1.5


def test_probe_by_a_saved_index_leaves_out_the_row_itself(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.round(clusters(rng, 600, 3), 0)
    refs = frame(spark, range(600), [str(i % 5) for i in range(600)], x)
    index = scoring.reference_index(refs, 4, chunk=32)
    index.save(str(tmp_path / "tree"))
    again = metric.Index.load(spark, str(tmp_path / "tree"))
    asked = np.vstack([x[:50], rng.normal(size=(50, 3)) * 60])
    rows = frame(spark, range(100), [None] * 100, asked).withColumn("is_ref", F.col("row_id") < 50)
    for which in (index, again):
        for own in (None, "is_ref"):
            found = {}
            for e in scoring.nearest_references(rows, which, 4, own=own).collect():
                found.setdefault(e["row_id"], []).append((e["d"], e["ref"], e["label"]))
            for i in range(100):
                order = sorted((float(np.sqrt(((asked[i] - x[j]) ** 2).sum())), j, str(j % 5)) for j in range(600) if not (own and i < 50 and j == i))[:4]
                assert [(j, c) for _, j, c in sorted(found[i])] == [(j, c) for _, j, c in order]
    with pytest.raises(ValueError):
        metric.probe(index, rows.select(F.col("row_id").alias("a"), F.lit("").alias("of"), F.col("x").alias("v")), 9)


def test_hot_balls_are_met_in_slices(spark, monkeypatch):
    monkeypatch.setattr(metric, "SLICE", 16)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(400, 2)) * 0.01, rng.normal(size=(100, 2)) * 10])
    df = frame(spark, range(500), ["a"] * 500, x)
    assert lists(graph.nearest(df, 3, chunk=16)) == brute(list(range(500)), ["a"] * 500, x, 3)


def test_queries_travel_once_a_shelf_where_bounds_exclude_nothing(spark, monkeypatch):
    """Gaussian rows in many dimensions, of which every ball has to be seen."""
    rng = np.random.default_rng(5)
    n, width = 1500, 24
    x = rng.normal(size=(n, width))
    x[700:720] = x[3]
    of = ["a" if i % 3 else "b" for i in range(n)]
    df = frame(spark, range(n), of, x)
    rows = cut(metric.marked(df.select(F.col("label").alias("of"), F.lit(None).cast("string").alias("label"), F.col("row_id").alias("id"), F.col("x").alias("v"))))
    index = metric.build(rows, 4, 16)
    shelf_bytes = 400 * width * 8
    monkeypatch.setattr(metric, "SHELF_BYTES", shelf_bytes)
    shelves = metric.Shelves.of(index)
    assert len(shelves.first) - 1 <= 6 and index.members.agg(F.max("ball")).first()[0] > 40
    upper, sent = (spark.sparkContext.broadcast(b) for b in (index.cells, shelves))
    first = index.members.groupBy("ball").applyInArrow(metric._meeting(4, upper, True, True, sent), metric.FIRST)
    assert first.agg(F.sum(F.size("visits"))).first()[0] <= n * (len(shelves.first) - 1)
    assert lists(graph.nearest(df, 3, chunk=16)) == brute(list(range(n)), of, x, 3)
    asked = frame(spark, range(60), [None] * 60, rng.normal(size=(60, width)))
    found = {}
    for e in scoring.nearest_references(asked, df, 5, chunk=16).collect():
        found.setdefault(e["row_id"], []).append((e["d"], e["ref"]))
    for r in asked.collect():
        order = sorted((float(np.sqrt(((np.array(r["x"]) - x[j]) ** 2).sum())), j) for j in range(n))[:5]
        assert [j for _, j in sorted(found[r["row_id"]])] == [j for _, j in order]
