"""Queries that SQL cannot say, against plain loops over the same rows."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.statistics import paired_t, wilcoxon
from lodestar.operators import calibration, maps, preprocess
from lodestar.plans.catalog import QUERIES
from lodestar.plans.catalog_vectors import base_rows, vectors

SF = "/root/testdata/sf0.001"


def test_nystrom_lengths_are_the_kernel_form(spark):
    rows = vectors(spark, SF)
    marks = maps.supervised_landmarks(rows, 24)
    found = {r["row_id"]: r for r in QUERIES["nystrom"](spark, SF).collect()}
    inverse = np.linalg.pinv(np.array([[math.exp(-((a - b) ** 2).sum()) for a in marks] for b in marks]))
    for r in rows.collect()[::7]:
        k = np.array([math.exp(-((np.array(r["x"]) - m) ** 2).sum()) for m in marks])
        assert found[r["row_id"]]["width"] == len(marks) and found[r["row_id"]]["norm"] == pytest.approx(k @ inverse @ k, abs=1e-5)


def positives(spark):
    """Distance to the own class's centre over its radius, by plain numpy."""
    by = {}
    for r in base_rows(spark, SF).collect():
        by.setdefault(r["label"], []).append(r["x"])
    out = {}
    for label, xs in by.items():
        x = np.array(xs)
        d = np.sort(np.linalg.norm(x - x.mean(0), axis=1))
        out[label] = d / max(d[math.ceil(0.9 * len(d)) - 1], 1e-6)
    return out


def test_pareto_tails_are_the_most_likely(spark):
    scores = positives(spark)
    found = QUERIES["evt_gpd"](spark, SF).collect()
    assert {r["label"] for r in found} == {k for k, v in scores.items() if len(v) > 4}
    for r in found:
        limit, x = np.sort(scores[r["label"]])[-5], np.sort(scores[r["label"]])[-4:] - np.sort(scores[r["label"]])[-5]

        def likelihood(shape, scale):
            inside = 1 + shape * x / scale  # noqa: B023
            if (inside <= 0).any():
                return -math.inf
            return -len(x) * math.log(scale) - ((x / scale).sum() if abs(shape) < 1e-9 else (1 + 1 / shape) * np.log(inside).sum())  # noqa: B023

        best = likelihood(r["shape"], r["scale"])
        near = [likelihood(r["shape"] + a, r["scale"] * b) for a in (-0.02, 0, 0.02) for b in (0.98, 1, 1.02)]
        assert best >= max(near) - 1e-6
        step = -r["scale"] * math.log(0.05) if abs(r["shape"]) < 1e-9 else r["scale"] / r["shape"] * (0.05 ** -r["shape"] - 1)
        assert r["tau"] == pytest.approx(limit + step, rel=1e-6)


def test_weibull_tails_are_the_most_likely(spark):
    scores = positives(spark)
    for r in QUERIES["evm_weibull"](spark, SF).collect():
        x = np.sort(scores[r["label"]])[-5:]

        def likelihood(shape, scale):
            return len(x) * (math.log(shape) - shape * math.log(scale)) + (shape - 1) * np.log(x).sum() - ((x / scale) ** shape).sum()  # noqa: B023

        best = likelihood(r["shape"], r["scale"])
        assert best >= max(likelihood(r["shape"] * a, r["scale"] * b) for a in (0.97, 1, 1.03) for b in (0.99, 1, 1.01)) - 1e-6


def test_leverage_trim_keeps_all_small_classes_and_ten_of_the_others(spark):
    sizes = {r["label"]: r["count"] for r in vectors(spark, SF).groupBy("label").count().collect()}
    found = QUERIES["leverage_trim"](spark, SF).collect()
    ids = {(r["label"], r["row_id"]) for r in vectors(spark, SF).select("label", "row_id").collect()}
    assert {(r["label"], r["seq"]) for r in found} <= ids and len({r["seq"] for r in found}) == len(found)
    for label, n in sizes.items():
        assert sum(r["label"] == label for r in found) == min(n, 10)


def test_normal_scores_follow_the_ranks(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.exponential(size=900), np.full(100, 0.5)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    fitted = preprocess.fit(df.drop("i"), preprocess.infer_schema(df.drop("i"), "none"), "quantile")
    found = {r["i"]: r["x"][0] for r in preprocess.transform(df, fitted, ("i",)).collect()}
    for i in range(0, 1000, 13):
        place = ((x < x[i]).sum() + (x <= x[i]).sum() - 1) / 2 / (len(x) - 1)
        if 0.01 < place < 0.99:
            assert found[i] == pytest.approx(NormalDist().inv_cdf(place), abs=0.03)
    assert found[int(x.argmax())] == pytest.approx(NormalDist().inv_cdf(1 - 1e-7), abs=1e-3)


def test_power_scores_are_standardised_transforms(spark):
    rows = QUERIES["scale_power"](spark, SF)
    item = spark.read.parquet(f"{SF}/lineitem.parquet")
    x = np.array([r[0] for r in item.orderBy("l_orderkey", "l_linenumber").select(F.col("l_quantity").cast("double")).collect()])
    got = np.array([r[0] for r in rows.orderBy("l_orderkey", "l_linenumber").select("l_quantity").collect()])
    costs = {}
    for lam in np.linspace(-1, 3, 401):
        y = preprocess.power(x, lam)
        costs[lam] = len(x) / 2 * math.log(y.var()) - (lam - 1) * np.log1p(x).sum()
    y = preprocess.power(x, min(costs, key=costs.get))
    assert np.allclose(got, (y - y.mean()) / y.std(), atol=0.02)


def test_significance_table_against_plain_tests(spark):
    runs = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_discount").alias("v")).collect()
    value = {(r["l_returnflag"], r["l_linestatus"], r["l_linenumber"]): r["v"] for r in runs}
    found = {(r["dataset"], r["method"]): r for r in QUERIES["significance"](spark, SF).collect()}
    want = {}
    for d, m in {(d, m) for d, m, _ in value if m != "F" and any(k[:2] == (d, "F") for k in value)}:
        seeds = sorted(s for x, y, s in value if (x, y) == (d, m) and (d, "F", s) in value)
        if seeds:
            a, b = (np.array([value[d, k, s] for s in seeds]) for k in ("F", m))
            want[d, m] = (a, b, paired_t(a, b)[1])
    assert set(found) == set(want) and want
    order = sorted(want, key=lambda k: (want[k][2], "|".join(k)))
    worst = 0.0
    for i, k in enumerate(order):
        a, b, p = want[k]
        worst = max(worst, min(1.0, p * (len(order) - i)))
        r = found[k]
        assert (r["seeds_won"], r["ours"], r["delta"]) == (int((a > b).sum()), pytest.approx(a.mean()), pytest.approx((a - b).mean()))
        assert r["paired_t_p"] == pytest.approx(p) and r["wilcoxon_p"] == pytest.approx(wilcoxon(a, b)) and r["holm_p"] == pytest.approx(worst)


def test_thresholds_by_grid_against_plain_search(spark):
    rng = np.random.default_rng(4)
    pos, neg = rng.normal(1, 0.3, 200), rng.normal(2, 0.5, 300)
    table = lambda x: spark.createDataFrame([(float(v),) for v in x], "score double")
    steps = np.quantile(np.concatenate([pos, neg]), np.linspace(0, 1, 64))
    good = [t for t in steps if (neg <= t).mean() <= 0.1 and (pos <= t).mean() >= 0.7]
    assert calibration.grid_search(table(pos), table(neg), 0.1, 0.7, 9.0) == pytest.approx(max(good))
    assert calibration.grid_search(table(pos), table(neg), 1e-9, 0.7, 9.0) == pytest.approx(np.quantile(pos, 0.7))
    assert calibration.grid_search(table(pos[:0]), table(neg[:0]), 0.1, 0.7, 9.0) == 9.0


def test_references_are_exact_quantiles_of_the_filled_column(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.exponential(size=5000), 2)
    y = [None if h else float(v) for v, h in zip(rng.normal(size=5000), rng.random(5000) < 0.2, strict=True)]
    df = spark.createDataFrame([(float(a), b) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(3)
    fitted = preprocess.fit(df, preprocess.infer_schema(df, "none"), "quantile", references=100)
    steps = np.linspace(0, 1, 100)
    filled = np.array([fitted.median["y"] if v is None else v for v in y])
    assert np.allclose(fitted.quantiles["x"], np.quantile(x, steps)) and np.allclose(fitted.quantiles["y"], np.quantile(filled, steps))
    assert fitted.median["y"] == pytest.approx(np.median([v for v in y if v is not None]))
