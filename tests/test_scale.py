"""Operators that are spread over tasks give what one task would, and their
plans hold no window without a key and no loop of scans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions.vectors import mean_vectors, vector_sums
from lodestar.operators import admission, graph, metrics, prototypes, running, splits
from lodestar.operators.prototypes import Bank


def test_running_sums_and_maxima(spark):
    rng = np.random.default_rng(1)
    rows = [("abc"[rng.integers(3)] if rng.random() < 0.9 else None, int(i), float(rng.integers(0, 9))) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v double").repartition(7)
    found = running.running(df, ["k"], [F.col("o")], {"s": F.col("v")}, {"m": F.col("v")}).toPandas().sort_values("o")
    want = pd.DataFrame(rows, columns=["k", "o", "v"]).assign(k=lambda d: d["k"].fillna("~"))
    assert (found["s"].to_numpy() == want.groupby("k")["v"].cumsum().to_numpy()).all()
    assert (found["m"].to_numpy() == want.groupby("k")["v"].cummax().to_numpy()).all()
    ranks = running.ranked(df, [], [F.desc("o")]).toPandas().sort_values("o")["rank"]
    assert ranks.tolist() == list(range(500, 0, -1))


def windows_without_keys(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line and "], [" not in line]


def test_no_task_orders_a_whole_table(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, float(i % 50)) for i in range(300)], "k long, u boolean, s double")
    for found in (metrics.auroc(df, [], "u", "s"), metrics.aupr(df, [], "u", "s"), metrics.holm(df.withColumn("p", F.col("s") / 100), "k", "p")):
        assert not windows_without_keys(found.where("true"))
    y, s = np.array([i % 3 == 0 for i in range(300)]), np.array([i % 50 for i in range(300)])
    pairs = (s[y][:, None] > s[~y]).mean() + (s[y][:, None] == s[~y]).mean() / 2
    assert metrics.auroc(df, [], "u", "s").first()["auroc"] == pytest.approx(pairs)


def test_neighbours_equal_brute_force_in_one_plan(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 5))
    label = ["hot" if i % 3 else "abcd"[i % 4] for i in range(2000)]
    df = spark.createDataFrame([(i, label[i], x[i].tolist()) for i in range(2000)], "row_id long, label string, x array<double>").cache()
    found = graph.nearest(df, 3, chunk=50)
    leaves = lambda df: df._jdf.queryExecution().analyzed().collectLeaves().size()
    assert leaves(found) == leaves(graph.nearest(df, 3, chunk=25))  # one plan, whatever the chunk
    got = {}
    for r in found.collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for i in range(0, 2000, 37):
        others = [j for j in range(2000) if j != i and label[j] == label[i]]
        order = sorted(others, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:3]
        assert [d for _, d in sorted(got[i])] == order


def test_first_rows_of_classes_are_exact(spark):
    rows = [(i, None if i % 97 == 0 else "hot" if i % 5 else "rare") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, label string").cache()
    first, rest = splits.first_rows(df, "label", "k", 25, 4)
    import hashlib

    order = lambda i: (hashlib.md5(f"4:{i}".encode()).hexdigest(), i)
    got = {}
    for r in first.collect():
        got.setdefault(r["label"], []).append((r["rank"], r["k"]))
    for name in ("hot", "rare", None):
        want = sorted((i for i, x in rows if x == name), key=order)[:25]
        assert [k for _, k in sorted(got[name])] == want
    assert rest.count() == 3000 - sum(map(len, got.values()))


def test_vector_sums_add_what_tasks_have(spark, monkeypatch):
    import lodestar.functions.vectors as v

    rng = np.random.default_rng(3)
    x, w, k = rng.standard_normal((400, 4)), rng.random(400), rng.integers(0, 7, 400)
    df = spark.createDataFrame([(f"u{k[i]}", int(k[i]) % 2, float(w[i]), x[i].tolist()) for i in range(400)], "u string, g int, w double, x array<double>").repartition(6)
    for held in (1 << 23, 16):
        monkeypatch.setattr(v, "HELD", held)
        for r in vector_sums(df, ["u", "g"], "x", "w", True).collect():
            own = k == int(r["u"][1:])
            assert r["n"] == pytest.approx(w[own].sum()) and r["rows"] == own.sum()
            assert np.allclose(r["s1"], w[own] @ x[own]) and np.allclose(np.array(r["s2"]).reshape(4, 4), (x[own] * w[own][:, None]).T @ x[own])
    assert vector_sums(df.where("false"), ["u"], "x").count() == 0
    with pytest.raises(Exception, match="weights sum to zero"):
        mean_vectors(df.withColumn("w", F.lit(0.0)), ["u"], "x", "w").collect()


def plain_cap(bank, cap):
    while len(bank.ids) > cap:
        _, i, j = prototypes.closest_pair(bank)
        bank = prototypes.merged(bank, i, j)
    return bank


def test_bank_cap_merges_the_closest_pairs_first(spark):
    rng = np.random.default_rng(4)
    n = 60
    bank = Bank([f"p{i:03d}" for i in range(n)], ["xyz"[i % 3] for i in range(n)], rng.standard_normal((n, 3)), rng.random(n), rng.random(n) + 0.5, ["stable"] * n)
    for cap in (45, 20, 3):
        other = plain_cap(bank, cap)
        for one in (prototypes.capped(bank, cap), prototypes.capped(bank, cap, spark)):
            assert one.ids == other.ids and one.labels == other.labels and np.allclose(one.centers, other.centers) and np.allclose(one.rho, other.rho) and np.allclose(one.weight, other.weight)


def test_a_full_bank_is_capped_within_a_minute(spark):
    import time

    rng = np.random.default_rng(9)
    n = 20_000
    bank = Bank([f"p{i:05d}" for i in range(n)], [f"c{i % 40}" for i in range(n)], rng.standard_normal((n, 32)), rng.random(n), rng.random(n) + 0.5, ["stable"] * n)
    began = time.monotonic()
    one = prototypes.capped(bank, 5000, spark)
    assert time.monotonic() - began < 60 and len(one.ids) == 5000 and one.weight.sum() == pytest.approx(bank.weight.sum())
    assert one.ids == sorted(one.ids) and set(one.labels) == set(bank.labels)


def test_screens_find_the_conflicts_of_plain_comparison(spark):
    rng = np.random.default_rng(5)
    rows, units = [], {}
    for u in range(8):
        center = rng.standard_normal(6) * (0.2 if u < 4 else 8)
        x = center + rng.standard_normal((5, 6)) * 0.5
        units[f"u{u}"] = (f"c{u % 4}", x)
        rows += [(f"u{u}", f"c{u % 4}", u * 10 + i, 1.0, 0.0, r.tolist()) for i, r in enumerate(x)]
    support = spark.createDataFrame(rows, "unit_id string, label string, seq long, w double, t double, phi array<double>").cache()
    outlines = admission.Outlines.of(support)
    assert np.allclose(outlines.centers, [units[u][1].mean(0) for u in outlines.ids])
    for most in (0.3, 1.0, 3.0):
        want = {c for c, x in units.values() if admission.affine_conflict(x, c, units, most)}
        for cell_bytes in (1, 600, 1 << 25):  # a cell for each unit, some, one
            for accepted in (["c0", "c1", "c2", "c3"], ["c1"], ["none"]):
                assert admission.conflicting_classes(support, accepted, most, cell_bytes=cell_bytes) == sorted(want & set(accepted))
    assert admission.conflicting_classes(support.where("false"), ["c0"], 1.0) == []


def test_hull_of_a_table_equals_the_hull_of_its_rows(spark):
    rng = np.random.default_rng(6)
    span, far = rng.standard_normal((4, 6)), rng.standard_normal((9, 6))
    table = lambda x: spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    got = admission.hull_distances(table(far), admission.hull_of(table(span))).agg(F.avg("residual")).first()[0]
    assert got == pytest.approx(admission.affine_residual(far, span), rel=1e-6)


def test_eviction_and_trims_equal_plain_orders(spark):
    rng = np.random.default_rng(7)
    rows = [(f"i{i}", ["pending", "blocked"][int(rng.random() < 0.3)], ["hot", "archived"][int(rng.random() < 0.2)], float(rng.integers(0, 20))) for i in range(80)]
    df = spark.createDataFrame(rows, "item_id string, status string, location string, created_at double")
    hot = sorted((r for r in rows if r[2] == "hot"), key=lambda r: r[0], reverse=True)
    hot = sorted(hot, key=lambda r: (r[1] == "blocked", -r[3]))
    keep = {r[0] for r in hot[:30]}
    for r in admission.evict(df, 30).collect():
        was = next(x[2] for x in rows if x[0] == r["item_id"])
        assert r["refresh_requested"] == (was == "hot" and r["item_id"] not in keep)
        assert r["location"] == ("archived" if r["refresh_requested"] else was)
    seqs = spark.createDataFrame([("hot" if i % 4 else "cold", i) for i in range(200)], "u string, seq long")
    kept = admission.trim(seqs, ["u"], 7, "uniform").collect()
    for u in ("hot", "cold"):
        own = [i for i in range(200) if ("hot" if i % 4 else "cold") == u]
        assert sorted(r["seq"] for r in kept if r["u"] == u) == sorted({own[i * (len(own) - 1) // 6] for i in range(7)})


def test_robust_scales_are_of_filled_columns(spark):
    from lodestar.operators import preprocess

    rng = np.random.default_rng(8)
    a, b = rng.exponential(size=301), rng.standard_normal(301)
    holes = rng.random(301) < 0.3
    df = spark.createDataFrame([(None if h else float(x), float(y)) for x, y, h in zip(a, b, holes, strict=True)], "a double, b double")
    fitted = preprocess.fit(df, preprocess.infer_schema(df, "none"), "robust")
    filled = np.where(holes, np.median(a[~holes]), a)
    for c, x in (("a", filled), ("b", b)):
        q = np.quantile(x, [0.25, 0.5, 0.75])
        assert fitted.shift[c] == pytest.approx(q[1]) and fitted.scale[c] == pytest.approx(q[2] - q[0])
    assert fitted.median["a"] == pytest.approx(np.median(a[~holes]))
