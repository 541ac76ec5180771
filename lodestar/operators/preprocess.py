"""Schema alignment, imputation, scaling and encoding as frozen statistics.

A fit is one aggregation whose few numbers come to the driver; a transform is
a projection with those numbers as literals, so it never shuffles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.session import cut, scope
from lodestar.operators.quantiles import exact_quantiles

#: Categories of one column; each becomes an output column.
MAX_CATEGORIES = 10_000
SCALERS = ("robust", "standard", "minmax", "power", "quantile")


@dataclass(frozen=True)
class Schema:
    """Ordered features and which of them are numbers."""

    label: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    order: tuple[str, ...]


@dataclass(frozen=True)
class Drift:
    missing: tuple[str, ...]
    extra: tuple[str, ...]


def infer_schema(df: DataFrame, label: str, numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> Schema:
    """Numbers by type, all else categorical; overrides win and may not overlap."""
    both = set(numeric) & set(categorical)
    if both:
        raise ValueError(f"numeric and categorical both name {sorted(both)}")
    features = [f for f in df.schema.fields if f.name != label]
    named = {f.name for f in features}
    if unknown := (set(numeric) | set(categorical)) - named:
        raise KeyError(f"no such columns: {sorted(unknown)}")
    is_number = lambda f: f.name in numeric or (f.name not in categorical and isinstance(f.dataType, T.NumericType))
    return Schema(label, tuple(f.name for f in features if is_number(f)), tuple(f.name for f in features if not is_number(f)), tuple(f.name for f in features))


def align(df: DataFrame, schema: Schema, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Drift]:
    """The schema's features in its order: missing ones null, others dropped."""
    have = set(df.columns)
    kinds = {**dict.fromkeys(schema.numeric, "double"), **dict.fromkeys(schema.categorical, "string")}
    chosen = [F.col(c).cast(kinds[c]).alias(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in schema.order]
    report = Drift(tuple(c for c in schema.order if c not in have), tuple(c for c in df.columns if c not in {*schema.order, *keep, schema.label}))
    return df.select(*keep, *chosen), report


@dataclass
class Fitted:
    """Statistics of one fit: medians and scales by numeric column, fill values
    and categories by categorical one."""

    schema: Schema
    scaler: str
    median: dict[str, float] = field(default_factory=dict)
    shift: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    lam: dict[str, float] = field(default_factory=dict)
    quantiles: dict[str, list[float]] = field(default_factory=dict)
    mode: dict[str, str | None] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    infrequent: dict[str, bool] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        """Output columns: numbers first, then one for each category."""
        made = [f"{c}={v}" for c in self.schema.categorical for v in [*self.categories[c], *(["infrequent"] if self.infrequent.get(c) else [])]]
        return [*self.schema.numeric, *made]


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of the values that are not null."""
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}


def modes(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of ties."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return counted.agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias(column))


def _ratio(x: float) -> float:
    return x if x and not math.isnan(x) else 1.0


def _power_fits(df: DataFrame, points: int = 16) -> dict[str, float]:
    """Maximum-likelihood exponents of the Yeo-Johnson transform. Distinct values
    are counted once; each pass over all of them, in tasks side by side, adds up the
    likelihood at points of each column's bracket, which then narrows to the
    neighbours of the best one."""
    names = df.columns
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(j).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for j, c in enumerate(names)))).alias("x")).select("x.*")
    with scope(df.sparkSession):
        counted = cut(pairs.where(F.abs("v") < math.inf).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
        brackets = {c: (-4.0, 6.0) for c in names}
        while max(high - low for low, high in brackets.values()) > 1e-7:
            tried = {c: np.linspace(low, high, 2 * points + 1) for c, (low, high) in brackets.items()}
            sums: dict[tuple[int, int], tuple[float, float, float, float]] = {}
            parts = counted.mapInArrow(_power_sums([tried[c] for c in names]), "c int, i int, n double, mean double, m2 double, logs double")
            for r in parts.collect():  # of each task one row for each column and point
                key = r["c"], r["i"]
                sums[key] = _merged(sums.get(key), (r["n"], r["mean"], r["m2"], r["logs"]))
            for j, c in enumerate(names):
                lams = tried[c]
                cost = [_power_cost(sums.get((j, i)), lam) for i, lam in enumerate(lams)]
                best = int(np.argmin(cost)) if np.isfinite(cost).any() else points
                brackets[c] = (float(lams[max(0, best - 1)]), float(lams[min(len(lams) - 1, best + 1)]))
    return {c: (low + high) / 2 for c, (low, high) in brackets.items()}


def _merged(a: tuple[float, float, float, float] | None, b: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """Count, mean, squared departures and sum of logs of two parts together."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n, a[3] + b[3]


def _power_cost(sums: tuple[float, float, float, float] | None, lam: float) -> float:
    if sums is None or not (np.isfinite(sums).all() and sums[2] > 0):
        return math.inf
    n, _, m2, logs = sums
    return n / 2 * math.log(m2 / n) - (lam - 1) * logs


def _power_sums(tried: list[np.ndarray]):
    def run(batches):
        sums: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                of, values, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                for j, lams in enumerate(tried):
                    own = np.flatnonzero(of == j)
                    if not len(own):
                        continue
                    x, n = values[own], counts[own].astype(float)
                    rows, logs = float(n.sum()), float(n @ (np.sign(x) * np.log1p(np.abs(x))))
                    for i, lam in enumerate(lams):
                        y = power(x, lam)
                        mean = float(n @ y) / rows
                        sums[j, i] = _merged(sums.get((j, i)), (rows, mean, float(n @ (y - mean) ** 2), logs))
        keys = list(sums)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([sums[k][v] for k in keys], pa.float64()) for v in range(4))]
        yield pa.RecordBatch.from_arrays(columns, names=["c", "i", "n", "mean", "m2", "logs"])

    return run


def power(x: np.ndarray, lam: float) -> np.ndarray:
    """The Yeo-Johnson transform."""
    out = np.empty_like(x, dtype=float)
    up = x >= 0
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-12 else (np.power(x[up] + 1, lam) - 1) / lam
    out[~up] = -np.log1p(-x[~up]) if abs(lam - 2) < 1e-12 else -(np.power(1 - x[~up], 2 - lam) - 1) / (2 - lam)
    return out


def power_column(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def fit(df: DataFrame, schema: Schema, scaler: str = "quantile", references: int = 1000, min_frequency: int | None = None, max_categories: int | None = None) -> Fitted:
    """One pass of aggregates for the numbers, one count for each categorical
    column. `power` searches its exponent in passes over all rows; `quantile`
    takes exact quantiles of the filled column as its references."""
    if scaler not in SCALERS:
        raise ValueError(f"unknown scaler {scaler!r}")
    if not schema.numeric and not schema.categorical:
        raise ValueError("no features")
    out = Fitted(schema, scaler)
    if schema.numeric:
        steps = [i / (references - 1) for i in range(references)]
        wanted = {"robust": [0.25, 0.5, 0.75], "quantile": [*steps, 0.5]}.get(scaler, [0.5])
        quartiles = exact_quantiles(df, list(schema.numeric), wanted)
        out.median = {c: 0.0 if v[0] is None else v[wanted.index(0.5)] for c, v in quartiles.items()}
        filled = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(out.median[c])).alias(c) for c in schema.numeric))
        if scaler == "quantile":
            holes = _holes(df, schema.numeric)
            found = quartiles | (exact_quantiles(filled, holes, steps) if holes else {})
            out.quantiles = {c: [x or 0.0 for x in v[:references]] for c, v in found.items()}
        elif scaler == "power":
            out.lam = _power_fits(filled)
            moved = filled.select(*(power_column(F.col(c), out.lam[c]).alias(c) for c in schema.numeric))
            _standard(moved, out)
        elif scaler == "standard":
            _standard(filled, out)
        elif scaler == "robust":
            holes = _holes(df, schema.numeric)
            found = quartiles | (exact_quantiles(filled, holes, [0.25, 0.5, 0.75]) if holes else {})
            out.shift = {c: v[1] or 0.0 for c, v in found.items()}
            out.scale = {c: _ratio(v[2] - v[0]) if v[0] is not None else 1.0 for c, v in found.items()}
        else:
            row = filled.agg(*(F.struct(F.min(c), F.max(c)).alias(c) for c in schema.numeric)).first().asDict()
            out.shift = {c: v[0] if v[0] is not None else 0.0 for c, v in row.items()}
            out.scale = {c: _ratio(v[1] - v[0]) if v[0] is not None else 1.0 for c, v in row.items()}
    for c in schema.categorical:
        out.mode[c] = modes(df, c).first()[c]
        out.categories[c], out.infrequent[c] = vocabulary(df, c, out.mode[c], min_frequency, max_categories)
    return out


def _holes(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    """Columns with nulls; filling moves the quantiles of these alone."""
    missing = df.agg(*(F.max(F.col(f"`{c}`").cast("double").isNull()).alias(str(i)) for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if missing[i]]


def _standard(df: DataFrame, out: Fitted) -> None:
    row = df.agg(*(F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in df.columns)).first().asDict()
    out.shift = {c: v[0] or 0.0 for c, v in row.items()}
    out.scale = {c: _ratio(v[1] or 0.0) for c, v in row.items()}


def frequencies(df: DataFrame, column: str, fill: str | None = None) -> DataFrame:
    """value, n, rank by falling count and value."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(fill))
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, column: str, fill: str | None, min_frequency: int | None, max_categories: int | None) -> tuple[list[str], bool]:
    """Sorted categories that keep a column of their own, and whether the rest
    shares one. With `max_categories`, that one counts too."""
    counted = frequencies(df, column, fill).where("value IS NOT NULL")
    kept = counted.where(F.col("n") >= min_frequency) if min_frequency else counted
    if max_categories:
        everything = counted.limit(max_categories + 1).count()
        if everything > max_categories or min_frequency:
            kept = kept.orderBy(F.desc("n"), "value").limit(max_categories - 1 if everything > max_categories else max_categories)
    values = sorted(r["value"] for r in kept.select("value").limit(MAX_CATEGORIES + 1).collect())
    if len(values) > MAX_CATEGORIES:
        raise ValueError(f"{column} has over {MAX_CATEGORIES} categories; bound them")
    rare = bool(min_frequency or max_categories) and counted.join(kept, "value", "left_anti").limit(1).count() > 0
    return values, rare


def transform(df: DataFrame, fitted: Fitted, keep: tuple[str, ...] = (), out: str = "x") -> DataFrame:
    """The kept columns and one dense array; numbers that are not finite are 0."""
    aligned, _ = align(df, fitted.schema, keep)
    columns = [_scaled(c, fitted) for c in fitted.schema.numeric]
    finite = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    parts = [F.array(*map(finite, columns))] if columns else []
    for c in fitted.schema.categorical:
        value = F.coalesce(F.col(c), F.lit(fitted.mode[c]))
        known = F.array(*map(F.lit, fitted.categories[c])) if fitted.categories[c] else F.array().cast("array<string>")
        parts.append(_hot(known, value))
        if fitted.infrequent.get(c):
            parts.append(F.array(F.coalesce((~F.array_contains(known, value)).cast("double"), F.lit(0.0))))
    return aligned.select(*keep, F.concat(*parts).alias(out))


def _hot(known: Column, value: Column) -> Column:
    return F.transform(known, lambda v: F.coalesce((v == value).cast("double"), F.lit(0.0)))


def _scaled(c: str, fitted: Fitted) -> Column:
    x = F.coalesce(F.col(c), F.lit(fitted.median[c]))
    if fitted.scaler == "quantile":
        return _normal_scores(np.array(fitted.quantiles[c], float))(x)
    if fitted.scaler == "power":
        x = power_column(x, fitted.lam[c])
    return (x - fitted.shift[c]) / fitted.scale[c]


def _normal_scores(reference: np.ndarray):
    """Share of the reference quantiles below (the mean of both sides of ties)
    to a normal score, clipped; an Arrow-batched function."""
    steps = np.linspace(0, 1, len(reference))
    edge = 1e-7
    grid = np.linspace(edge, 1 - edge, 20_001)
    scores = np.array([NormalDist().inv_cdf(p) for p in grid])

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        up = np.interp(v, reference, steps)
        down = -np.interp(-v, -reference[::-1], -steps[::-1])
        return pd.Series(np.interp(np.clip((up + down) / 2, edge, 1 - edge), grid, scores))

    return score
