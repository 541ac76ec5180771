"""Explicit feature maps, bandwidth rules, whitening and soft-null projection.

Weights are drawn on the driver from a seed and broadcast; rows pass by in
Arrow batches. Everything fitted is a few matrices of the map's width.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.session import cut
from lodestar.functions.vectors import matrix
from lodestar.operators.splits import shuffled

KINDS = ("identity", "rff", "laplacian", "nystrom")
#: Rows that bandwidth rules look at.
GAMMA_ROWS, MEDIAN_ROWS = 2000, 5000


@dataclass
class Map:
    """A fitted map: x -> cos features, kernel features or x itself, between
    optional whitening before and after."""

    kind: str
    width: int
    omega: np.ndarray | None = None
    phase: np.ndarray | None = None
    landmarks: np.ndarray | None = None
    root: np.ndarray | None = None
    gamma: float = 1.0
    kernel: str = "rbf"
    before: np.ndarray | None = None
    after: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.width:
            raise ValueError(f"{x.shape[1]} columns, the map takes {self.width}")
        x = x if self.before is None else x @ self.before.T
        if self.kind in ("rff", "laplacian"):
            x = np.sqrt(2 / self.omega.shape[1]) * np.cos(x @ self.omega + self.phase)
        elif self.kind == "nystrom":
            x = kernel(x, self.landmarks, self.gamma, self.kernel) @ self.root.T
        return x if self.after is None else x @ self.after.T

    def save(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()})

    @classmethod
    def load(cls, text: str) -> Map:
        return cls(**{k: np.array(v, float) if isinstance(v, list) else v for k, v in json.loads(text).items()})


def kernel(x: np.ndarray, y: np.ndarray, gamma: float, name: str = "rbf") -> np.ndarray:
    if name == "linear":
        return x @ y.T
    if name == "laplacian":
        return np.exp(-gamma * np.abs(x[:, None, :] - y[None]).sum(2))
    if name != "rbf":
        raise ValueError(f"unknown kernel {name!r}")
    return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def fit(kind: str, width: int, n: int, gamma: float, seed: int = 0, landmarks: np.ndarray | None = None, kernel_name: str = "rbf") -> Map:
    """Draw the map's weights; `landmarks` for the kernel map."""
    rng = np.random.default_rng(seed)
    if kind == "identity":
        return Map(kind, width)
    if kind == "rff":
        return Map(kind, width, np.sqrt(2 * gamma) * rng.standard_normal((width, n)), rng.uniform(0, 2 * np.pi, n), gamma=gamma)
    if kind == "laplacian":
        return Map(kind, width, gamma * rng.standard_cauchy((width, n)), rng.uniform(0, 2 * np.pi, n), gamma=gamma)
    if kind == "nystrom":
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks, gamma, kernel_name))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
        return Map(kind, width, landmarks=landmarks, root=root, gamma=gamma, kernel=kernel_name)
    raise ValueError(f"unknown map {kind!r}")


def apply(df: DataFrame, fitted: Map, vector: str = "x", out: str = "phi") -> DataFrame:
    """All columns and `out`: array<double>."""
    sent = df.sparkSession.sparkContext.broadcast(fitted)
    at = df.columns.index(vector)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phi = sent.value(matrix(batch.column(at))) if batch.num_rows else np.zeros((0, 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(phi) + 1) * phi.shape[1], pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, out])

    return df.mapInArrow(run, kind)


def gamma_knn(df: DataFrame, k: int = 20, key: str = "row_id", vector: str = "x", rows: int = GAMMA_ROWS, seed: int = 0) -> float:
    """1 / mean squared distance to the k-th nearest other row, on at most
    `rows` rows in shuffled order."""
    x = sample(df, rows, key, vector, seed)
    if len(x) < 2:
        return 1.0
    square = (x * x).sum(1)
    k = min(k, len(x) - 1)
    total = 0.0
    for at in range(0, len(x), 256):
        some = x[at : at + 256]
        rough = square[at : at + 256, None] + square - 2 * some @ x.T
        rough[np.arange(len(some)), np.arange(at, at + len(some))] = np.inf
        near = np.argpartition(rough, k - 1, axis=1)[:, k - 1]
        total += ((some - x[near]) ** 2).sum()
    mean = float(total) / len(x)
    return 1.0 / mean if mean > 1e-12 else 1.0


def gamma_median(df: DataFrame, key: str = "row_id", vector: str = "x", rows: int = MEDIAN_ROWS, seed: int = 0) -> float:
    """1 / median squared distance between the halves of the shuffled rows."""
    x = sample(df, rows, key, vector, seed)
    half = min(len(x) // 2, 2000)
    if not half:
        return 1.0
    a, b = x[:half], x[len(x) // 2 : len(x) // 2 + half]
    middle = float(np.median(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)))
    return 1.0 / middle if middle > 1e-12 else 1.0


def sample(df: DataFrame, rows: int, key: str, vector: str, seed: int) -> np.ndarray:
    """At most `rows` vectors in shuffled order (a bounded top-k)."""
    picked = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).orderBy(shuffled(F.col("k"), seed), "k").limit(rows)
    return matrix(picked.toArrow().column("v"))


def landmark_allocation(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Landmarks by class: the n largest classes one each if there are too few,
    else one each and the rest by largest remainder of their shares."""
    order = sorted(sizes, key=lambda c: (-sizes[c], c))
    if n < len(order):
        return {c: int(i < n) for i, c in enumerate(order)}
    out, rest, total = dict.fromkeys(order, 1), n - len(order), sum(sizes.values())
    quota = {c: rest * sizes[c] / total for c in order}
    for c in order:
        out[c] += int(quota[c])
    left = n - sum(out.values())
    for c in sorted(order, key=lambda c: (-(quota[c] - int(quota[c])), c))[:left]:
        out[c] += 1
    return out


def supervised_landmarks(df: DataFrame, n: int, key: str = "row_id", label: str = "label", vector: str = "x", seed: int = 0) -> np.ndarray:
    """Rows nearest to the centres of a k-means in each class, without repeats,
    filled up in shuffled order. Sizes and centres are of all rows: each round
    is a pass that adds up the rows of each centre."""
    rows = cut(df.select(F.col(key).alias("k"), F.col(label).cast("string").alias("c"), F.col(vector).cast("array<double>").alias("v"), shuffled(F.col(key), seed).alias("o")))
    sizes = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    n = min(n, sum(sizes.values()))
    wanted = {c: k for c, k in landmark_allocation(sizes, n).items() if k}
    if not wanted:
        return np.zeros((0, 0))
    most = F.broadcast(df.sparkSession.createDataFrame(list(wanted.items()), "c string, most long"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("o", "k"))).where(F.col("r") <= max(wanted.values())).join(most, "c").where("r <= most")
    centers: dict[str, np.ndarray] = {}
    for r in sorted(first.collect(), key=lambda r: r["r"]):
        centers[r["c"]] = np.vstack([*([centers[r["c"]]] if r["c"] in centers else []), np.array(r["v"])[None, :]])
    moving = set(centers)
    for _ in range(20):
        found = _around(rows.where(F.col("c").isin(sorted(moving))), {c: centers[c] for c in moving}, False)
        for c in sorted(moving):
            moved = np.array([found[c, i][1] / found[c, i][0] if (c, i) in found else m for i, m in enumerate(centers[c])])
            if np.allclose(moved, centers[c]):
                moving.discard(c)
            else:
                centers[c] = moved
        if not moving:
            break
    nearest = _around(rows, centers, True)
    chosen: dict[str, np.ndarray] = {}
    for c in wanted:
        for i in range(len(centers[c])):
            _, v, o = nearest[c, i]
            chosen.setdefault(o, v)
    for r in rows.orderBy("o", "k").limit(2 * n).collect() if len(chosen) < n else []:
        if len(chosen) < n:
            chosen.setdefault(r["o"], np.array(r["v"]))
    return np.array(list(chosen.values()))


def _around(rows: DataFrame, centers: dict[str, np.ndarray], nearest: bool) -> dict[tuple[str, int], tuple]:
    """By class and centre: count and sum of the rows closest to it, or the
    distance, vector and order mark of the row nearest to it."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                of, x, marks = np.array(batch.column(0).to_pylist(), object), matrix(batch.column(1)), batch.column(2).to_pylist()
                for c in {c for c in of if c in sent.value}:
                    own = np.flatnonzero(of == c)
                    d = np.stack([((x[own] - m) ** 2).sum(1) for m in sent.value[c]], 1)
                    for i in range(d.shape[1]):
                        if nearest:
                            j = min(np.flatnonzero(d[:, i] == d[:, i].min()), key=lambda j: marks[own[j]])
                            part = (float(d[j, i]), x[own[j]], marks[own[j]])
                            held[c, i] = min(held.get((c, i), part), part, key=lambda p: (p[0], p[2]))
                        else:
                            mine = own[d.argmin(1) == i]
                            if len(mine):
                                count, total, _ = held.get((c, i), (0.0, 0.0, ""))
                                held[c, i] = (count + len(mine), total + x[mine].sum(0), "")
        keys, parts = list(held), list(held.values())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([p[0] for p in parts], pa.float64()), pa.array([p[1].tolist() for p in parts], pa.list_(pa.float64())), pa.array([p[2] for p in parts], pa.string())], names=["c", "i", "n", "v", "o"])

    out: dict[tuple[str, int], tuple] = {}
    for r in rows.select("c", "v", "o").mapInArrow(run, "c string, i int, n double, v array<double>, o string").toLocalIterator():
        at, part = (r["c"], r["i"]), (r["n"], np.array(r["v"]), r["o"])
        if at not in out:
            out[at] = part
        else:
            out[at] = min(out[at], part, key=lambda p: (p[0], p[2])) if nearest else (out[at][0] + part[0], out[at][1] + part[1], "")
    return out


def whitening(within: np.ndarray, n: float, epsilon: float = 1e-10) -> np.ndarray:
    """Symmetric inverse root of the mean within-class scatter, eigenvalues
    floored."""
    values, vectors = np.linalg.eigh((within + within.T) / (2 * max(n, 1.0)))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, epsilon))) @ vectors.T


@dataclass
class Projection:
    matrix: np.ndarray
    mode: str
    spectrum: np.ndarray


def soft_null(total: np.ndarray, within: np.ndarray, most: int, range_share: float = 1e-8, null_share: float = 1e-2, ridge: float = 0.0) -> Projection:
    """Directions of the data's range in which classes scatter least."""
    if ridge:
        within = within + ridge * np.trace(within) / len(within) * np.eye(len(within))
    values, vectors = np.linalg.eigh(total)
    keep = values > max(range_share * values[-1], np.finfo(float).eps * max(1.0, values[-1]))
    if not keep.any():
        raise ValueError("the data have no range to project on")
    basis = vectors[:, keep]
    inside = basis.T @ within @ basis
    small, axes = np.linalg.eigh((inside + inside.T) / 2)
    small, axes = small[: max(1, most)], axes[:, : max(1, most)]
    positive = small[small > 0]
    null = small <= null_share * (np.median(positive) if len(positive) else 0.0)
    if null.any():
        return Projection(basis @ axes[:, null], "epsilon_null", small[null])
    return Projection(basis @ axes, "min_scatter_fallback", small)


def pca(total: np.ndarray, most: int) -> Projection:
    values, vectors = np.linalg.eigh(total)
    return Projection(vectors[:, ::-1][:, :most], "pca", values[::-1][:most])


def random_projection(width: int, most: int, seed: int = 0) -> Projection:
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, most)))
    return Projection(q, "random", np.zeros(most))


def warm_start(new: np.ndarray, old: np.ndarray | None, blend: float) -> np.ndarray:
    """Orthonormal basis of a blend with the former projection, as wide as both."""
    if old is None or blend <= 0 or old.shape[0] != new.shape[0]:
        return new
    d = min(new.shape[1], old.shape[1])
    q, _ = np.linalg.qr((1 - blend) * new[:, :d] + blend * old[:, :d])
    return q


def augment(rows: np.ndarray, least: int, regular: float, rng: np.random.Generator) -> np.ndarray:
    """Draws from a class's Gaussian until it has `least` rows."""
    if len(rows) >= least or not len(rows):
        return rows
    spread = np.cov(rows.T, bias=True).reshape(rows.shape[1], -1) if len(rows) > 1 else np.zeros((rows.shape[1],) * 2)
    root = np.linalg.cholesky(spread + regular * np.eye(rows.shape[1]))
    return np.vstack([rows, rows.mean(0) + rng.standard_normal((least - len(rows), rows.shape[1])) @ root.T])
