"""Reservoirs of calibration scores and reject thresholds.

Scores stay in a table (kind: pos, imp or unk; label; seq; score). Quantiles
over all scores come from `exact_quantiles`, which no task gathers; those by
class are percentiles of reservoirs, which hold so many scores of a class at
most. Only the threshold itself comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.statistics import pareto_fit, pareto_quantile, weibull_fit
from lodestar.operators.quantiles import exact_quantiles

#: Quantiles that the grid search tries.
GRID = 64


def last(df: DataFrame, keys: list[str], n: int, seq: str = "seq") -> DataFrame:
    """The last n rows of each group in order of `seq`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def reservoir(scores: DataFrame, kind: str, most: int) -> DataFrame:
    """The last `most` scores of a kind in order of seq (then label and score);
    each task hands on so many at most."""
    return scores.where(F.col("kind") == kind).orderBy(F.desc("seq"), F.desc("label"), F.desc("score")).limit(most)


def balanced(df: DataFrame, label: str = "label", seq: str = "seq") -> DataFrame:
    """Of each class as many of its last rows as the smallest class has."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return last(df, [label], least, seq)


def grid_search(pos: DataFrame, neg: DataFrame, alpha: float, beta: float, fallback: float, grid: int = GRID) -> float:
    """The largest candidate with a false-accept rate of at most alpha and a
    true-accept rate of at least beta; else the beta quantile of `pos`, else
    `fallback`. Candidates are quantiles of all scores."""
    steps = [i / (grid - 1) for i in range(grid)]
    found = exact_quantiles(pos.select("score").unionByName(neg.select("score")), ["score"], steps)["score"]
    if found[0] is None:
        return fallback
    values = sorted(set(found))
    shares = lambda df: df.agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("score") <= v).cast("long")).alias(f"c{i}") for i, v in enumerate(values))).first()
    p, n = shares(pos), shares(neg)
    if not p["n"]:
        return fallback
    good = [v for i, v in enumerate(values) if (n[f"c{i}"] or 0) <= alpha * n["n"] and p[f"c{i}"] >= beta * p["n"]]
    return max(good) if good else quantile(pos, beta, fallback)


def quantile(df: DataFrame, q: float, fallback: float) -> float:
    value = exact_quantiles(df, ["score"], [q])["score"][0]
    return fallback if value is None else value


def leave_one_out(pos: DataFrame, neg: DataFrame, alpha: float, beta: float, current: float) -> float:
    """The smallest class quantile, held down by the negatives' 1 - alpha
    quantile but not below 0.8 of itself; two classes at least. `pos` holds a
    reservoir of each class."""
    by_class = pos.groupBy("label").agg(F.percentile("score", beta).alias("q")).agg(F.min("q").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if by_class["n"] < 2:
        return current
    limit = exact_quantiles(neg, ["score"], [1 - alpha])["score"][0]
    t = by_class["t"]
    return t if limit is None else min(t, max(limit, 0.8 * t))


def by_class_quantile(pos: DataFrame, q: float, tau: float, least: int = 5) -> DataFrame:
    """label, tau: each class's quantile within [0.3, 3] of the global one; the
    global one for classes of under `least` scores."""
    found = pos.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.percentile("score", q).alias("q"))
    held = F.greatest(F.lit(0.3 * tau), F.least(F.lit(3 * tau), F.col("q")))
    return found.select("label", F.when(F.col("n") < least, F.lit(tau)).otherwise(held).alias("tau"))


def tails(df: DataFrame, k: int, key: str = "label") -> DataFrame:
    """key, score, threshold, excess: the k largest scores of each group above
    the next one; groups of k or fewer have none."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "seq")
    ranked = df.withColumn("_r", F.row_number().over(w))
    limit = ranked.where(F.col("_r") == k + 1).select(key, F.col("score").alias("threshold"))
    return ranked.where(F.col("_r") <= k).join(limit, key).select(key, "score", "threshold", (F.col("score") - F.col("threshold")).alias("excess"))


def pareto_by_group(df: DataFrame, k: int, p: float, key: str = "label") -> DataFrame:
    """key, shape, scale, tau: fitted on the k largest excesses of each group,
    which bounds what a task holds."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        shape, scale = pareto_fit(rows["excess"].to_numpy(float))
        return pd.DataFrame({key: [rows[key].iloc[0]], "shape": [shape], "scale": [scale], "tau": [rows["threshold"].iloc[0] + pareto_quantile(p, shape, scale)]})

    return tails(df, k, key).groupBy(key).applyInPandas(fit, f"{key} string, shape double, scale double, tau double")


def evt(pos: DataFrame, k: int, p: float, beta: float, current: float) -> float:
    """The largest fitted class threshold, else the beta quantile."""
    value = pareto_by_group(pos, k, p).agg(F.max("tau").alias("t")).first()["t"]
    return quantile(pos, beta, current) if value is None or not np.isfinite(value) else value


def by_prototype(pos: DataFrame, k: int, p: float, tau: float, multiplier: float, ids: list[str]) -> dict[str, float]:
    """A threshold for each prototype within [0.3, 2] of the global one; those
    with too few scores get multiplier times the global one."""
    found = {r["prototype_id"]: r["tau"] for r in pareto_by_group(pos, k, p, "prototype_id").collect()}
    return {i: min(max(found[i], 0.3 * tau), 2 * tau) if i in found else multiplier * tau for i in ids}


def weibull_by_class(pos: DataFrame, k: int) -> dict[str, tuple[float, float]]:
    """Shape and scale on the k largest distances of each class, three at least."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        shape, scale = weibull_fit(rows["score"].to_numpy(float))
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "n": [len(rows)], "shape": [shape], "scale": [scale]})

    top = pos.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "seq"))).where(F.col("_r") <= k)
    rows = top.select("label", "score").groupBy("label").applyInPandas(fit, "label string, n long, shape double, scale double").where("n >= 3").collect()
    return {r["label"]: (r["shape"], r["scale"]) for r in rows}
