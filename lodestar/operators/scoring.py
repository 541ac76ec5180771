"""Scoring rows against a prototype bank, and the reject rule.

The bank is broadcast (its size is checked when it is made) and rows pass by in
Arrow batches: each batch is a few matrix operations, no row is multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.session import cut
from lodestar.functions.vectors import matrix
from lodestar.operators import metric
from lodestar.operators.prototypes import Bank

MODES = ("min_distance", "mahalanobis", "relative_mahalanobis", "energy", "ghost", "reciprocal", "hyperspherical", "evm", "knn")
TIE, LEAST = 1e-12, 1e-12
BLOCK = 1024


@dataclass
class Rule:
    """How to score; only what the mode needs is read."""

    mode: str = "min_distance"
    temperature: float = 1.0
    inner_temperature: np.ndarray | None = None
    reciprocal_weight: float = 0.5
    weibull: dict[str, tuple[float, float]] = field(default_factory=dict)
    evm_threshold: float = 0.5
    ghost_alpha: float = 0.05
    precision: np.ndarray | None = None
    background: tuple[np.ndarray, np.ndarray] | None = None
    points: np.ndarray | None = None
    penalty: tuple[str, float] | None = None
    tie_break: float | None = None
    dual: float | None = None
    full: Bank | None = None
    tau: float | None = None
    block: int = BLOCK

    def only(self, keep: list[int]) -> Rule:
        """The rule for some of the prototypes, by distances alone."""
        per = lambda x: None if x is None else x[keep]
        precision = self.precision if self.shared() else per(self.precision)
        return replace(self, penalty=None, tie_break=None, dual=None, full=None, precision=precision, points=per(self.points), inner_temperature=per(self.inner_temperature))

    def shared(self) -> bool:
        """Whether one precision (a diagonal or, but for `ghost`, whose diagonals
        are rows, a matrix) holds for all prototypes."""
        return self.precision is not None and self.precision.ndim <= (1 if self.mode == "ghost" else 2)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances, by exact differences in blocks."""
    out = np.empty((len(x), len(y)))
    for j in range(len(y)):
        out[:, j] = ((x - y[j]) ** 2).sum(1)
    return out


def mahalanobis(x: np.ndarray, centers: np.ndarray, precision: np.ndarray, shared: bool) -> np.ndarray:
    """Distances under a diagonal, one matrix, or a matrix for each centre."""
    out = np.empty((len(x), len(centers)))
    for j, c in enumerate(centers):
        away = x - c
        p = precision if shared else precision[j]
        out[:, j] = ((away * p if p.ndim == 1 else away @ p) * away).sum(1)
    return np.sqrt(np.maximum(out, 0))


def first_least(d: np.ndarray) -> np.ndarray:
    """Column of each row's least value; within 1e-12 the lowest column."""
    return (d <= d.min(1, keepdims=True) + TIE).argmax(1)


def chi2_sf(x: np.ndarray, d: int) -> np.ndarray:
    """Upper tail of chi square: a finite sum for even d, from the normal tail
    upwards for odd d."""
    half = np.maximum(np.asarray(x, float), 0) / 2
    if d % 2 == 0:
        term, total = np.ones_like(half), np.ones_like(half)
        for i in range(1, d // 2):
            term = term * half / i
            total = total + term
        return np.exp(-half) * total
    total = np.array([math.erfc(math.sqrt(h)) for h in half.ravel()]).reshape(half.shape)
    term = np.exp(-half) * np.sqrt(half) / math.gamma(1.5)
    for i in range((d - 1) // 2):
        total = total + term
        term = term * half / (i + 1.5)
    return total


def softmin(d: np.ndarray, t: float, inner: np.ndarray | None = None) -> np.ndarray:
    """-t * log sum exp(-d / t) along rows; `inner`: each column's own t within."""
    z = -d / (t if inner is None else inner)
    top = z.max(1, keepdims=True)
    return -t * (top[:, 0] + np.log(np.exp(z - top).sum(1)))


def class_temperatures(bank: Bank, t: float, power: float) -> np.ndarray:
    """t times (class support / median support) ^ power, by prototype."""
    weights = bank.class_weight()
    middle = float(np.median(list(weights.values())))
    return np.array([t * (weights[c] / middle) ** power for c in bank.labels])


def penalty_factors(bank: Bank, form: str, alpha: float) -> np.ndarray:
    """1 + alpha * (f(support) / f(median) - 1) by prototype, f log or sqrt."""
    f = {"log": math.log, "sqrt": math.sqrt}[form]
    weights = bank.class_weight()
    middle = f(max(float(np.median(list(weights.values()))), 2.0))
    return np.array([1 + alpha * (f(max(weights[c], 1.0)) / middle - 1) for c in bank.labels])


def tie_broken(d: np.ndarray, bank: Bank, nearest: np.ndarray, above: float) -> np.ndarray:
    """Where the two nearest classes are closer than the ratio `above`, the
    prototype of the one with less support; equal supports keep the nearest."""
    labels, weights = np.array(bank.labels, object), bank.class_weight()
    classes = bank.classes
    if len(classes) < 2:
        return nearest
    columns = [np.flatnonzero(labels == c) for c in classes]
    least = np.stack([d[:, c].min(1) for c in columns], 1)
    best = np.stack([c[first_least(d[:, c])] for c in columns], 1)
    order = np.argsort(least, axis=1, kind="stable")[:, :2]
    rows = np.arange(len(d))
    d1, d2 = least[rows, order[:, 0]], least[rows, order[:, 1]]
    support = np.array([weights[c] for c in classes])
    swap = (d1 / np.maximum(d2, LEAST) > above) & (support[order[:, 1]] < support[order[:, 0]])
    close = d1 / np.maximum(d2, LEAST) > above
    return np.where(close, np.where(swap, best[rows, order[:, 1]], best[rows, order[:, 0]]), nearest)


def evaluate(x: np.ndarray, bank: Bank, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """score, prototype that decides about rejection, prototype of the class."""
    root = np.sqrt(squared(x, bank.centers))
    normal = root / np.maximum(bank.rho, LEAST)
    nearest = first_least(normal)
    rows = np.arange(len(x))
    if rule.mode == "ghost":
        statistic = ((x[:, None, :] - bank.centers) ** 2 * rule.precision).sum(2)
        at = first_least(statistic)
        return 1 - chi2_sf(statistic[rows, at], x.shape[1]), at, at
    if rule.mode == "reciprocal":
        points = rule.points if rule.points is not None else bank.reciprocal()[0]
        value = root - rule.reciprocal_weight * np.sqrt(squared(x, points))
        at = first_least(value)
        return value[rows, at], at, at
    if rule.mode == "hyperspherical":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), LEAST)
        value = 1 - unit(x) @ unit(bank.centers).T
        at = first_least(value)
        return value[rows, at], at, at
    if rule.mode == "evm":
        labels = np.array(bank.labels, object)
        best, at = np.full(len(x), -1.0), np.zeros(len(x), int)
        for c in bank.classes:
            own = np.flatnonzero(labels == c)
            least = normal[:, own]
            where = own[first_least(least)]
            shape, scale = rule.weibull.get(c, (1.0, 1.0))
            inside = np.exp(-np.power(np.maximum(least.min(1), 0) / scale, shape))
            at = np.where(inside > best, where, at)
            best = np.maximum(best, inside)
        return 1 - best, at, at
    if rule.mode in ("mahalanobis", "relative_mahalanobis"):
        value = mahalanobis(x, bank.centers, rule.precision, rule.shared())
        at = first_least(value)
        score = value[rows, at]
        if rule.mode == "relative_mahalanobis":
            mean, inverse = rule.background
            score = score - np.sqrt(np.maximum(np.einsum("nd,de,ne->n", x - mean, inverse, x - mean), 0))
            return score, at, at
    elif rule.mode == "energy":
        at, score = nearest, softmin(normal, rule.temperature, rule.inner_temperature)
    else:
        at, score = nearest, normal[rows, nearest]
    if rule.penalty:
        score = score * penalty_factors(bank, *rule.penalty)[at]
    of_class = tie_broken(normal, bank, at, rule.tie_break) if rule.tie_break is not None else at
    return score, at, of_class


def reference_index(reference: DataFrame, k: int, key: str = "row_id", label: str = "label", vector: str = "x", chunk: int = metric.CHUNK) -> metric.Index:
    """The references (key, label, vector) as a metric index that gives k
    neighbours of a row, and still k where a row itself is left out."""
    rows = reference.select(F.lit("").alias("of"), F.col(label).cast("string").alias("label"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return metric.build(cut(metric.marked(rows)), k + 1, chunk)


def nearest_references(df: DataFrame, reference: DataFrame | metric.Index, k: int, key: str = "row_id", label: str = "label", vector: str = "x", chunk: int = metric.CHUNK, ref_key: str | None = None, own: str | None = None) -> DataFrame:
    """row_id, ref, label, d: the k nearest of all reference rows for each row,
    ties by ref, by an index of the references (made here from a table).
    Where the column `own` is true, the row is a reference too and does not see
    itself. Rows without a vector have none."""
    if isinstance(reference, DataFrame):
        reference = reference_index(reference, k, ref_key or key, label, vector, chunk)
    rows = df.select(F.col(key).cast("long").alias("row_id"), (F.col(own) if own else F.lit(False)).alias("own"), F.col(vector).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("a"))
    rows = cut(rows)
    found = metric.probe(reference, rows.select("a", F.lit("").alias("of"), "v"), k + 1 if own else k)
    others = F.filter("found", lambda x: ~F.coalesce(F.col("own"), F.lit(False)) | (x["ref"] != F.col("row_id")))
    near = rows.select("a", "row_id", "own").join(found, "a").select("row_id", F.explode(F.slice(others, 1, k)).alias("x"))
    return near.select("row_id", F.col("x.ref").alias("ref"), F.col("x.label").alias("label"), F.sqrt("x.d2").alias("d"))


def knn_vote(found: DataFrame) -> DataFrame:
    """row_id, label, score: the most frequent label (then the smaller one) of
    the nearest references and the distance of the furthest."""
    votes = found.groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
    return votes.groupBy("row_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.max("d").alias("score"))


def effective_tau(bank: Bank, tau: float, by_class: dict[str, float] | None = None) -> np.ndarray:
    """Each prototype's threshold: its class's, else its own fitted one, else
    the global one, which an override can lower unless it is stable."""
    out = np.full(len(bank.ids), tau)
    for i, (label, status) in enumerate(zip(bank.labels, bank.status, strict=True)):
        if by_class and label in by_class:
            out[i] = by_class[label]
        elif not math.isnan(bank.local[i]):
            out[i] = bank.local[i]
        elif status != "stable" and not math.isnan(bank.override[i]):
            out[i] = min(tau, bank.override[i])
    return out


def thresholds(bank: Bank, rule: Rule, tau: float, by_class: dict[str, float] | None = None) -> np.ndarray:
    """Each prototype's threshold under a rule; some modes have a fixed one."""
    if rule.mode == "ghost":
        return np.full(len(bank.ids), 1 - rule.ghost_alpha)
    if rule.mode == "evm":
        return np.full(len(bank.ids), 1 - rule.evm_threshold)
    return effective_tau(bank, rule.tau if rule.tau is not None else tau, by_class)


def predict(df: DataFrame, bank: Bank, rule: Rule, tau: float, key: str = "row_id", vector: str = "x", by_class: dict[str, float] | None = None, full_vector: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, kept columns, predicted_label (null if rejected), accepted, best_class_label,
    best_prototype_id, best_prototype_status, score, threshold. With
    `rule.dual`, scores blend both spaces by the maxima of the whole input."""
    taus = thresholds(bank, rule, tau, by_class)
    sent = df.sparkSession.sparkContext.broadcast((bank, rule, taus))
    vectors = [F.col(v).cast("array<double>").alias(f"x{i}") for i, v in enumerate([vector] + [full_vector] * bool(full_vector))]
    rows = df.select(F.col(key).alias("key"), *vectors, F.struct(F.col(key).alias("key"), *keep).alias("kept"))
    named = Naming(bank, taus, rule.full.labels if rule.dual is not None else bank.labels)
    ids = f"key {rows.schema['key'].dataType.simpleString()}, kept {rows.schema['kept'].dataType.simpleString()}"
    dual = rule.dual is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank, rule, _ = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, rule.block):
                batch = whole.slice(at, rule.block)
                score, reject, chosen = evaluate(matrix(batch.column(1)), bank, rule)
                first = [batch.column(0), batch.column(batch.num_columns - 1)]
                if not dual:
                    yield named.batch(first, score, reject, chosen, chosen)
                    continue
                d = np.sqrt(squared(matrix(batch.column(2)), rule.full.centers)) / np.maximum(rule.full.rho, LEAST)
                other_at = first_least(d)
                yield pa.RecordBatch.from_arrays([*first, pa.array(score), pa.array(reject.astype(np.int64)), pa.array(other_at.astype(np.int64)), pa.array(d[np.arange(len(d)), other_at])], names=["key", "kept", "score", "reject", "named", "other"])

    if not dual:
        return unkept(rows.mapInArrow(run, f"{ids}, {OUTCOME}"), key, keep)
    scored = cut(rows.mapInArrow(run, f"{ids}, score double, reject long, named long, other double"))
    most = scored.agg(F.max("score"), F.max("other")).first()
    top, wide = max(most[0] or 0.0, LEAST), max(most[1] or 0.0, LEAST)
    return named.applied(scored.withColumn("score", (rule.dual * F.col("score") / top + (1 - rule.dual) * F.col("other") / wide) * top), key, keep)


@dataclass
class Member:
    """One of several models that score the same rows: from rows to vectors, and
    what `predict` takes."""

    vectors: Callable[[np.ndarray], np.ndarray]
    bank: Bank
    rule: Rule
    taus: np.ndarray
    version: int = 0


def predict_members(df: DataFrame, members: list[Member], key: str = "row_id", vector: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """`predict` of every member with `member` and `projection_version`: a row
    for each member, made side by side as the rows pass once."""
    sent = df.sparkSession.sparkContext.broadcast([(m, Naming(m.bank, m.taus, m.bank.labels)) for m in members])
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"), F.struct(F.col(key).alias("key"), *keep).alias("kept"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = matrix(batch.column(1))
                for i, (m, named) in enumerate(sent.value):
                    score, reject, chosen = evaluate(m.vectors(x), m.bank, m.rule)
                    found = named.batch([batch.column(0), batch.column(2)], score, reject, chosen, chosen)
                    more = [pa.array(np.full(len(x), v), pa.int32()) for v in (i, m.version)]
                    yield pa.RecordBatch.from_arrays([*found.columns, *more], names=[*found.schema.names, "member", "projection_version"])

    found = rows.mapInArrow(run, f"key {kinds['key']}, kept {kinds['kept']}, {OUTCOME}, member int, projection_version int")
    return found.select(F.col("key").alias(key), *(F.col(f"kept.`{c}`").alias(c) for c in keep), *(c.split(" ")[0] for c in OUTCOME.split(", ")), "member", "projection_version")


OUTCOME = "predicted_label string, accepted boolean, best_class_label string, best_prototype_id string, best_prototype_status string, score double, threshold double"


def unkept(found: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    return found.select(F.col("key").alias(key), *(F.col(f"kept.`{c}`").alias(c) for c in keep), *(c.split(" ")[0] for c in OUTCOME.split(", ")))


@dataclass
class Naming:
    """From scores and places in the bank to labels, prototypes and decisions;
    `labels` are what `named` places stand for."""

    bank: Bank
    taus: np.ndarray
    labels: list[str]

    def batch(self, first: list, score: np.ndarray, reject: np.ndarray, named: np.ndarray, chosen: np.ndarray | None = None) -> pa.RecordBatch:
        """One batch: rejected if the score is above the threshold of prototype
        `reject`; an accepted row is told with prototype `chosen`, if there is one."""
        threshold = self.taus[reject] if len(reject) else np.zeros(0)
        accepted = ~(score > threshold)
        told = pa.array(reject if chosen is None else np.where(accepted, chosen, reject), pa.int64())
        names = pa.array(self.labels, pa.string()).take(pa.array(named, pa.int64()))
        predicted = pc.if_else(pa.array(accepted), names, pa.scalar(None, pa.string()))
        columns = [predicted, pa.array(accepted), names, pa.array(self.bank.ids, pa.string()).take(told), pa.array(self.bank.status, pa.string()).take(told), pa.array(score, pa.float64()), pa.array(threshold, pa.float64())]
        return pa.RecordBatch.from_arrays([*first, *columns], names=["key", "kept", *(c.split(" ")[0] for c in OUTCOME.split(", "))])

    def applied(self, scored: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
        """The same for a table of key, kept, score, reject and named."""
        sent = scored.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score, reject, named = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                yield sent.value.batch(batch.columns[:2], score, reject, named)

        kinds = {f.name: f.dataType.simpleString() for f in scored.schema.fields}
        return unkept(scored.select("key", "kept", "score", F.col("reject").cast("long"), F.col("named").cast("long")).mapInArrow(run, f"key {kinds['key']}, kept {kinds['kept']}, {OUTCOME}"), key, keep)


def predict_by_vote(df: DataFrame, reference: DataFrame | metric.Index, bank: Bank, k: int, tau: float, key: str = "row_id", vector: str = "x", by_class: dict[str, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """`predict` by the labels of the k nearest support rows (seq, label,
    vector; or an index of them); the score is the distance of the furthest of them. A row stands for
    the first prototype of the class it is given."""
    rows = cut(df.select(F.col(key).alias("key"), F.struct(F.col(key).alias("key"), *keep).alias("kept"), F.col(vector).alias("x"), F.monotonically_increasing_id().alias("at")))
    found = knn_vote(nearest_references(rows, reference, k, "at", "label", "x", ref_key="seq"))
    first = {c: bank.labels.index(c) for c in bank.classes}
    place = F.coalesce(F.create_map(*(F.lit(v) for item in first.items() for v in item))[F.col("label")], F.lit(0))
    scored = rows.join(found.withColumnRenamed("row_id", "at"), "at").select("key", "kept", "score", place.alias("reject"), place.alias("named"))
    return Naming(bank, effective_tau(bank, tau, by_class), bank.labels).applied(scored, key, keep)


def accepted(score: Column, threshold: Column) -> Column:
    """Rejected only if the score is above the threshold."""
    return ~(score > threshold)
