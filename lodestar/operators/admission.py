"""Support upkeep, pending items, budgets and conflict gates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.exact import exponential
from lodestar.functions.session import cut
from lodestar.functions.vectors import matrix, mean_vectors, squared_distance
from lodestar.operators.prototypes import Bank
from lodestar.operators.running import ranked

#: Bytes of Gram matrices that are held at a time.
GRAM_BYTES = 1 << 26
TRIMS = ("latest", "head", "uniform", "leverage")


def trim(df: DataFrame, keys: list[str], most: int, how: str = "uniform", seq: str = "seq", vector: str = "phi", seed: int = 0) -> DataFrame:
    """At most `most` rows of each unit: the latest, the first, evenly spaced
    ones, or the ones that weigh most in the unit's span with a hashed draw."""
    if how not in TRIMS:
        raise ValueError(f"unknown trim {how!r}")
    if how == "leverage":
        return _by_leverage(df, keys, most, seq, vector, seed)
    if how in ("latest", "head"):  # a rank limit, which tasks apply before rows meet
        order = Window.partitionBy(*keys).orderBy(F.desc(seq) if how == "latest" else F.col(seq))
        return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
    sizes = df.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    placed = ranked(df, keys, [F.col(seq)], "_r").join(sizes, same)
    # Position i of `most` falls on floor(i * (n - 1) / (most - 1)).
    i = F.ceil((F.col("_r") - 1) * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1))) if most > 1 else F.lit(0)
    place = F.floor(i * (F.col("_n") - 1) / max(most - 1, 1))
    return placed.where((F.col("_n") <= most) | ((place == F.col("_r") - 1) & (i < most))).select(*df.columns)


def _by_leverage(df: DataFrame, keys: list[str], most: int, seq: str, vector: str, seed: int) -> DataFrame:
    """Leverages come from the d x d Gram matrix of all rows of each unit that
    is too large; matrices of at most GRAM_BYTES are broadcast at a time."""
    rows = cut(df)
    unit = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    over = sorted(r["unit"] for r in rows.groupBy(unit.alias("unit")).count().where(F.col("count") > most).collect())
    if not over:
        return rows
    width = rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first()[0]
    step = max(1, GRAM_BYTES // (8 * width * (width + 1)))
    spark = df.sparkSession
    named = lambda names: spark.createDataFrame([(x,) for x in names], "_unit string")
    placed = rows.withColumn("_unit", unit)
    out = placed.join(named(over), "_unit", "left_anti").select(*df.columns)
    for at in range(0, len(over), step):
        mine = placed.join(F.broadcast(named(over[at : at + step])), "_unit", "left_semi")
        means = {u: s / n for u, (n, s, _) in _unit_sums(mine, vector, None).items()}
        grams = {u: g for u, (_, _, g) in _unit_sums(mine, vector, means).items()}
        sent = spark.sparkContext.broadcast({u: (means[u], _inverse_root(g)) for u, g in grams.items()})
        weighed = mine.withColumn("_weight", _weights(sent)(F.col("_unit"), F.col(vector).cast("array<double>")))
        share = (F.pmod(F.xxhash64(F.lit(seed), F.col(seq)), F.lit(1 << 32)) + 0.5) / (1 << 32)
        top = Window.partitionBy("_unit").orderBy(F.desc(F.log(share) / F.col("_weight")), seq)
        out = out.unionByName(weighed.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= most).select(*df.columns))
    return out


def _unit_sums(rows: DataFrame, vector: str, means: dict[str, np.ndarray] | None) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and, with means, Gram matrix about the mean of each unit."""
    sent = rows.sparkSession.sparkContext.broadcast(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            units, x = np.array(batch.column(0).to_pylist(), object), matrix(batch.column(1))
            for u in set(units):
                own = x[units == u]
                away = own - sent.value[u] if sent.value else own[:0]
                part = [float(len(own)), own.sum(0), away.T @ away]
                held[u] = [a + b for a, b in zip(held[u], part, strict=True)] if u in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.float64()), pa.array([v[1].tolist() for v in held.values()], pa.list_(pa.float64())), pa.array([v[2].ravel().tolist() if sent.value else [] for v in held.values()], pa.list_(pa.float64()))], names=["u", "n", "s", "g"])

    found: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}
    for r in rows.select("_unit", F.col(vector).cast("array<double>")).mapInArrow(run, "u string, n double, s array<double>, g array<double>").toLocalIterator():
        part = (r["n"], np.array(r["s"]), np.array(r["g"]))
        found[r["u"]] = tuple(a + b for a, b in zip(found[r["u"]], part, strict=True)) if r["u"] in found else part
    return {u: (n, s, g.reshape(len(s), len(s)) if means else g) for u, (n, s, g) in found.items()}


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    """Columns that turn a centred row into its coordinates of unit spread;
    directions without spread are left out."""
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > max(1e-20, 1e-13 * max(values[-1], 0.0))
    return axes[:, keep] / np.sqrt(values[keep])


def _weights(sent):
    @F.pandas_udf("double")
    def weigh(units: pd.Series, rows: pd.Series) -> pd.Series:
        out, x = np.zeros(len(rows)), np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, 0))
        for u in set(units):
            at = (units == u).to_numpy()
            mean, root = sent.value[u]
            out[at] = (((x[at] - mean) @ root) ** 2).sum(1) + 1e-12
        return pd.Series(out)

    return weigh


def decayed(df: DataFrame, now: float, rate: float, drop_below: float, weight: str = "w", time: str = "t") -> DataFrame:
    """Weights times exp(-rate * age); rows under `drop_below` go. Of whole
    times and a short rate the exponent is their decimal product, rounded once."""
    age, share = F.lit(float(now)) - F.col(time), -F.lit(rate)
    written = Decimal(repr(float(-rate)))
    if isinstance(df.schema[time].dataType, T.IntegralType) and float(now).is_integer() and 0 <= -written.as_tuple().exponent <= 15:
        age, share = (F.lit(int(now)) - F.col(time)).cast("decimal(19,0)"), F.lit(written)
    aged = df.withColumn(weight, F.col(weight) * exponential((share * age).cast("double"))) if rate > 0 else df
    return aged.where(F.col(weight) >= drop_below)


def cache_items(pending: DataFrame, batch: DataFrame, batch_id: str, now: float, label: str = "label") -> DataFrame:
    """One pending item for each class of a labelled batch (id batch:class);
    items already there stay as they are."""
    made = batch.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows")).select(F.concat_ws(":", F.lit(batch_id), "label").alias("item_id"), "label", "rows", F.lit("pending").alias("status"), F.lit("hot").alias("location"), F.lit(float(now)).alias("created_at"))
    return pending.unionByName(made.join(pending.select("item_id"), "item_id", "left_anti"))


def evict(pending: DataFrame, budget: int) -> DataFrame:
    """Hot items over the budget move to the archive: blocked ones first, then
    the oldest; they ask for a refresh. The `budget` that stay are a bounded
    top-k of the table."""
    hot = F.col("location") == "hot"
    stays = pending.where(hot).orderBy((F.col("status") == "blocked").cast("int"), F.desc("created_at"), F.desc("item_id")).limit(budget)
    found = pending.join(stays.select(F.col("item_id").alias("_stays")), F.col("item_id") == F.col("_stays"), "left")
    out = F.coalesce(hot & F.col("_stays").isNull(), F.lit(False))
    return found.withColumns({"location": F.when(out, "archived").otherwise(F.col("location")), "refresh_requested": out}).drop("_stays")


def archive_victim(weights: DataFrame, protected: list[str]) -> DataFrame:
    """The class of least support (then name) that is not protected; none if all are."""
    free = weights.where(~F.col("label").isin(protected)) if protected else weights
    return free.orderBy("weight", "label").limit(1)


def margin_conflict(candidate: tuple[Column, Column, Column], deployed: tuple[Column, Column, Column], tau: float, margin: float) -> Column:
    """Whether two prototypes (label, center, rho) of different classes are no
    further apart than tau times their radii and the margin."""
    (la, ca, ra), (lb, cb, rb) = candidate, deployed
    return (la != lb) & (F.sqrt(squared_distance(ca, cb)) <= tau * (ra + rb) + margin)


def passes_margin(candidate: Bank, deployed: Bank, tau: float, margin: float) -> bool:
    for label, c, r in zip(candidate.labels, candidate.centers, candidate.rho, strict=True):
        others = np.flatnonzero(np.array(deployed.labels, object) != label)
        if len(others) and (np.linalg.norm(deployed.centers[others] - c, axis=1) <= tau * (r + deployed.rho[others]) + margin).any():
            return False
    return True


Hull = tuple[np.ndarray, np.ndarray]


def hull(span: np.ndarray) -> Hull:
    """Mean and orthonormal directions of the affine hull of some rows."""
    _, s, vt = np.linalg.svd(span - span.mean(0), full_matrices=False)
    return span.mean(0), vt[s > 1e-10]


def hull_of(df: DataFrame, vector: str = "x") -> Hull:
    """The same of all rows of a table, from its moments."""
    from lodestar.operators.prototypes import moments

    n, s1, s2 = moments(df, vector)
    if not n:
        raise ValueError("no rows span a hull")
    values, axes = np.linalg.eigh(s2 - np.outer(s1, s1) / n)
    return s1 / n, axes[:, values > max(1e-20, 1e-12 * values[-1])].T


def hull_distances(df: DataFrame, of: Hull, vector: str = "x", out: str = "residual") -> DataFrame:
    """Rows with their distance from an affine hull, in Arrow batches."""
    sent = df.sparkSession.sparkContext.broadcast(of)

    @F.pandas_udf("double")
    def far(rows: pd.Series) -> pd.Series:
        mean, basis = sent.value
        away = np.stack(rows.to_numpy()) - mean if len(rows) else np.zeros((0, len(mean)))
        return pd.Series(np.linalg.norm(away - away @ basis.T @ basis, axis=1))

    return df.withColumn(out, far(F.col(vector).cast("array<double>")))


def affine_residual(rows: np.ndarray, span: np.ndarray) -> float:
    """Mean distance of rows to the affine hull of `span`."""
    if not len(span) or not len(rows):
        return float("inf")
    mean, basis = hull(span)
    away = rows - mean
    return float(np.linalg.norm(away - away @ basis.T @ basis, axis=1).mean())


def affine_conflict(rows: np.ndarray, label: str, units: dict[str, tuple[str, np.ndarray]], most: float, shortlist: int | None = None) -> bool:
    """Whether rows lie in the affine hull of a unit of another class. Units are
    tried by distance of centres; those whose radii cannot meet are skipped."""
    center = rows.mean(0)
    radius = np.linalg.norm(rows - center, axis=1).max()
    near = sorted((float(np.linalg.norm(v.mean(0) - center)), u) for u, (c, v) in units.items() if c != label)
    for d, u in near[:shortlist]:
        v = units[u][1]
        if d > radius + np.linalg.norm(v - v.mean(0), axis=1).max() + most:
            continue
        if min(affine_residual(rows, v), affine_residual(v, rows)) <= most:
            return True
    return False


@dataclass
class Outlines:
    """Centre and radius of each unit, all that a screen needs at first."""

    ids: list[str]
    labels: list[str]
    centers: np.ndarray
    radii: np.ndarray

    @classmethod
    def of(cls, support: DataFrame, vector: str = "phi") -> Outlines:
        """From support rows (unit_id, label, vector); units are as many as
        prototypes at most."""
        from lodestar.operators.prototypes import MAX_PROTOTYPES

        keys = ["unit_id", "label"]
        centers = cut(mean_vectors(support, keys, vector))
        if centers.count() > MAX_PROTOTYPES:
            raise ValueError("more units than a bank holds")
        near = support.select(*keys, F.col(vector).alias("_v")).join(centers, keys)
        found = near.groupBy(*keys).agg(F.max(F.sqrt(squared_distance(F.col("_v"), F.col("center")))).alias("r"), F.first("center").alias("center")).collect()
        found.sort(key=lambda r: r["unit_id"])
        width = len(found[0]["center"]) if found else 0
        return cls([r["unit_id"] for r in found], [r["label"] for r in found], np.array([r["center"] for r in found]).reshape(len(found), width), np.array([r["r"] for r in found]))

    def near(self, center: np.ndarray, radius: float, label: str, most: float, shortlist: int | None = None) -> list[str]:
        """Units of other classes, nearest first, whose radii can meet."""
        others = np.flatnonzero(np.array(self.labels, object) != label)
        d = np.linalg.norm(self.centers[others] - center, axis=1) if len(others) else np.zeros(0)
        order = np.lexsort((others, d))[:shortlist]
        return [self.ids[others[i]] for i in order if d[i] <= radius + self.radii[others[i]] + most]


#: Bytes of the bundles of one cell, and of all pivots.
CELL_BYTES, PIVOT_BYTES = 1 << 25, 1 << 26


def bundles(support: DataFrame, vector: str = "phi") -> DataFrame:
    """unit_id, label, center, radius, rows and v (all vectors of a unit, one
    after another): a row for each unit, whose rows are bounded."""
    flat = support.select("unit_id", "label", F.col(vector).cast("array<double>").alias("v"))
    made = flat.groupBy("unit_id", "label").agg(F.collect_list("v").alias("vs"))

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                v = matrix(batch.column(2)[at].values)
                center = v.mean(0)
                radius = float(np.linalg.norm(v - center, axis=1).max())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, 1) for i in (0, 1)), pa.array([center.tolist()]), pa.array([radius]), pa.array([len(v)], pa.int32()), pa.array([v.ravel()], pa.list_(pa.float64()))], names=["unit_id", "label", "center", "radius", "rows", "v"])

    return made.mapInArrow(outlined, "unit_id string, label string, center array<double>, radius double, rows int, v array<double>")


def conflicting_classes(support: DataFrame, accepted: list[str], most: float, vector: str = "phi", cell_bytes: int = CELL_BYTES) -> list[str]:
    """Accepted classes of which a unit lies in the affine hull of a unit of
    another class, or the other way round (mean residual at most `most`).

    A band join of balls: units are dealt to the cells of pivots, and a unit of
    an accepted class is sent to the cells whose units its ball can meet, by the
    distance to the pivot and how far the cell's balls reach. There units are
    screened by centres and radii and those that meet are compared row by row.
    A unit's rows travel once, and once for each cell it can meet; no pair is
    listed, and the driver holds one number for each cell. Cells are bounded in
    bytes, of units and of visitors."""
    spark = support.sparkSession
    units = cut(bundles(support, vector))
    size = units.agg(F.count(F.lit(1)), F.max(F.size("center")), F.sum(F.col("rows").cast("long") * F.size("center") * 8)).first()
    if not size[0]:
        return []
    wanted = max(1, min(-(-size[2] // cell_bytes), PIVOT_BYTES // (8 * size[1])))
    pivots = np.array([r["center"] for r in units.orderBy(F.xxhash64("unit_id"), "unit_id").limit(wanted).select("center").collect()])  # within PIVOT_BYTES
    sent = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.sqrt(np.maximum(((matrix(batch.column(1))[:, None, :] - sent.value) ** 2).sum(2), 0)) if batch.num_rows else np.zeros((0, 1))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell] + batch.column(2).to_numpy())], names=["unit_id", "cell", "far"])

    cells = cut(units.select("unit_id", "center", "radius").mapInArrow(placed, "unit_id string, cell int, far double"))
    reach = np.full(len(pivots), -np.inf)
    for r in cells.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a number for each cell
        reach[r["cell"]] = r["far"]
    upper = spark.sparkContext.broadcast(reach)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            d = np.sqrt(((x[:, None, :] - sent.value) ** 2).sum(2)) if batch.num_rows else np.zeros((0, 1))
            room = 1e-9 * (d + np.abs(upper.value, where=np.isfinite(upper.value), out=np.zeros(len(reach))))
            i, cell = np.nonzero(d <= batch.column(2).to_numpy()[:, None] + upper.value + most + room)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(cell, pa.int32())], names=["unit_id", "cell"])

    visits = units.where(F.col("label").isin(accepted)).select("unit_id", "center", "radius").mapInArrow(routed, "unit_id string, cell int")
    width = 8 * size[1]
    sized = visits.join(units.select("unit_id", (F.col("rows") * width).alias("bytes")), "unit_id")
    slices = cut(sized.groupBy("cell").agg(F.ceil(F.sum("bytes") / cell_bytes).cast("int").alias("slices")))
    asked = visits.join(F.broadcast(slices), "cell").select("unit_id", "cell", F.pmod(F.xxhash64("unit_id"), "slices").cast("int").alias("slice"), F.lit(True).alias("own"))
    there = cells.join(F.broadcast(slices), "cell").select("unit_id", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("own"))
    met = asked.unionByName(there).join(units, "unit_id")
    found = met.groupBy("cell", "slice").applyInArrow(_judged(most), "label string")
    return sorted(r["label"] for r in found.distinct().collect())


def _judged(most: float):
    def run(group: pa.Table) -> pa.Table:
        own = group.column("own").to_numpy(zero_copy_only=False).astype(bool)
        labels, centers = np.array(group.column("label").to_pylist(), object), matrix(group.column("center"))
        radius = group.column("radius").to_numpy()
        v, spans = group.column("v").combine_chunks(), {}

        def rows(i: int) -> np.ndarray:
            return v[i].values.to_numpy().reshape(-1, centers.shape[1])

        def span(i: int) -> Hull:
            if i not in spans:
                spans[i] = hull(rows(i))
            return spans[i]

        def residual(i: int, j: int) -> float:
            mean, basis = span(j)
            away = rows(i) - mean
            return float(np.linalg.norm(away - away @ basis.T @ basis, axis=1).mean())

        out: set[str] = set()
        others = np.flatnonzero(~own)
        for i in np.flatnonzero(own).tolist():
            if labels[i] in out:
                continue
            some = others[labels[others] != labels[i]]
            d = np.linalg.norm(centers[some] - centers[i], axis=1)
            for j in some[d <= radius[i] + radius[some] + most].tolist():
                if min(residual(i, j), residual(j, i)) <= most:
                    out.add(labels[i])
                    break
        return pa.table({"label": pa.array(sorted(out), pa.string())})

    return run


def over_budget(counts: dict[str, int], limits: dict[str, int]) -> list[str]:
    """Names of state budgets that are exceeded."""
    return [k for k, most in limits.items() if counts.get(k, 0) > most]


def skip_reason(train: Column, calibration: Column, test: Column, support: Column, least: int) -> Column:
    """First reason to leave an episode out, null for none."""
    return F.when(train < 1, "no_training_rows").when(calibration < 1, "no_calibration_rows").when(test < 1, "no_test_rows").when(support < least, "too_little_support")
