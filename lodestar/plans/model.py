"""Fit, prediction, admission and refresh of the open-set classifier.

A model's large part, its support (at most `unit_rows` rows of each unit), is a
table in the shared folder; all else is a few small arrays. A change makes a
new model of the next version; the old one stays valid until it is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.labels import UNKNOWN
from lodestar.functions.session import clustered, cut, scope
from lodestar.functions.vectors import matrix, mean_vectors, vector_sums
from lodestar.operators import admission, calibration, graph, maps, metric, preprocess, prototypes, scoring
from lodestar.operators.ledger import REBUILD, Ledger
from lodestar.operators.maps import Map, Projection
from lodestar.operators.preprocess import Fitted
from lodestar.operators.prototypes import Bank
from lodestar.operators.quantiles import exact_quantiles
from lodestar.plans.config import ModelConfig

#: Rows that an admission takes; more are an error.
MAX_ADMITTED = 10_000
SUPPORT = "unit_id string, label string, seq long, w double, t double, phi array<double>"


@dataclass
class Model:
    config: ModelConfig
    fitted: Fitted
    map: Map
    support: DataFrame
    projection: Projection
    bank: Bank
    tau: float
    by_class: dict[str, float] = field(default_factory=dict)
    weibull: dict[str, tuple[float, float]] = field(default_factory=dict)
    version: int = 0
    log: list[dict] = field(default_factory=list)
    exemplars: tuple[np.ndarray, list[str]] | None = None
    held: DataFrame | None = None
    scales: prototypes.Scales | None = None
    background: tuple[np.ndarray, np.ndarray] | None = None
    archive: DataFrame | None = None
    index: metric.Index | None = None
    ledger: Ledger | None = None

    @property
    def classes(self) -> list[str]:
        return self.bank.classes

    def rule(self) -> scoring.Rule:
        """How this model scores: what its mode needs is taken from the bank."""
        c, bank = self.config, self.bank
        inner = scoring.class_temperatures(bank, c.temperature, c.class_temperature) if c.class_temperature and bank.ids else None
        precision = None
        if c.mode == "mahalanobis":
            precision = prototypes.precisions(bank, c.adaptive_shrinkage)
        elif c.mode == "relative_mahalanobis":
            precision = self.background[1]
        elif c.mode == "ghost":
            precision = prototypes.diagonal_precisions(bank)
        points = bank.reciprocal()[0] if c.mode == "reciprocal" else None
        full = replace(bank, centers=bank.wide, rho=bank.wide_rho) if c.dual is not None else None
        return scoring.Rule(mode=c.mode, temperature=c.temperature, inner_temperature=inner, reciprocal_weight=c.reciprocal_weight, weibull=self.weibull, evm_threshold=c.evm_threshold, ghost_alpha=c.ghost_alpha, precision=precision, background=self.background, points=points, penalty=c.penalty, tie_break=c.tie_break, dual=c.dual, full=full)

    def references(self) -> metric.Index:
        """Support rows, indexed, that votes are taken from; made once for a
        support and a projection."""
        if self.index is None:
            rows = project(self.support, self.projection.matrix).select("seq", "label", "z")
            self.index = scoring.reference_index(rows, self.config.knn, "seq", "label", "z")
        return self.index


def featurise(df: DataFrame, fitted: Fitted, mapped: Map, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and phi."""
    return maps.apply(preprocess.transform(df, fitted, keep), mapped).drop("x")


def project(df: DataFrame, w: np.ndarray, vector: str = "phi", out: str = "z") -> DataFrame:
    """Rows onto the projection, in Arrow batches."""
    return maps.apply(df, Map("identity", w.shape[0], after=w.T), vector, out)


def gamma_of(df: DataFrame, rule: float | str, seed: int) -> float:
    if not isinstance(rule, str):
        return float(rule)
    name, _, k = rule.partition("-")
    return maps.gamma_median(df, seed=seed) if name == "median" else maps.gamma_knn(df, int(k or 20), seed=seed)


def by_class(support: DataFrame) -> DataFrame:
    """Support as a table in order of class and unit, of which a refresh reads
    the classes it touches."""
    return clustered(support, ["label", "unit_id"], ["seq"])


def build_support(phi: DataFrame, config: ModelConfig, now: float = 0.0) -> DataFrame:
    """Localise (row_id, label, phi) into units, settle residual rows, trim."""
    least = config.augment_below
    source = phi
    if least:
        extra = _augmented(phi, least, config.seed)
        source = phi.unionByName(extra)
    placed = graph.localise(source, config.neighbours, config.least_unit, vector="phi")
    rows = phi.join(placed.select("row_id", "unit_id"), "row_id")
    if config.residual == "drop":
        rows = rows.where(F.col("unit_id").isNotNull())
    elif config.residual == "preserve":
        rows = rows.withColumn("unit_id", F.coalesce("unit_id", F.concat_ws(":", F.lit("fragile"), "label", F.col("row_id").cast("string"))))
    else:
        rows = cut(rows)
        units = mean_vectors(rows.where("unit_id IS NOT NULL"), ["unit_id", "label"], "phi")
        joined = graph.nearest_unit(rows.where("unit_id IS NULL").select("row_id", "label", F.col("phi").alias("x")), cut(units))
        settled = rows.where("unit_id IS NULL").drop("unit_id").join(joined.select("row_id", "unit_id"), "row_id").where("unit_id IS NOT NULL")
        rows = rows.where("unit_id IS NOT NULL").unionByName(settled)
    rows = rows.select("unit_id", "label", F.col("row_id").alias("seq"), F.lit(1.0).alias("w"), F.lit(float(now)).alias("t"), "phi")
    return admission.trim(rows, ["unit_id"], config.unit_rows, config.trim)


#: Rows that are drawn together.
DRAWN = 1024


def _augmented(phi: DataFrame, least: int, seed: int, regular: float = 1e-6) -> DataFrame:
    """Drawn rows (negative ids) that fill classes of under `least` rows from
    the Gaussian of their moments. A class meets as sums only, and its draws
    are dealt in blocks, each with a seed of its own."""
    small = phi.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first")).where(F.col("n") < least)
    own = phi.join(small.select("label"), "label", "left_semi")
    sums = vector_sums(own, ["label"], "phi", second=True).drop("n").join(small.select("label", "first"), "label")
    blocks = sums.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((least - F.col("rows") - 1) / DRAWN).cast("int"))))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, width = r["rows"], len(r["s1"])
                mean = np.array(r["s1"]) / n
                spread = np.array(r["s2"]).reshape(width, width) / n - np.outer(mean, mean)
                values, axes = np.linalg.eigh((spread + spread.T) / 2)
                root = axes * np.sqrt(np.maximum(values, 0.0) + regular)
                start = r["block"] * DRAWN
                size = min(DRAWN, least - n - start)
                x = mean + np.random.default_rng([seed, r["block"], *(r["label"] or "").encode()]).standard_normal((size, width)) @ root.T
                ids = -(r["first"] * least + 1 + np.arange(start, start + size))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r["label"]] * size, pa.string()), pa.array(list(x), pa.list_(pa.float64()))], names=["row_id", "label", "phi"])

    return blocks.select("label", "rows", "s1", "s2", "first", "block").mapInArrow(draw, "row_id long, label string, phi array<double>")


def ledger_of(support: DataFrame, config: ModelConfig) -> Ledger:
    """Moments of all support, by the weights that the settings give."""
    weighted = prototypes.balanced_weights(support, power=config.balance_power) if config.balance_power else support
    found = Ledger.of(weighted)
    if found is None:
        raise ValueError("no support to fit on")
    return found


def ledger_after(model: Model, support: DataFrame, changed: list[str], config: ModelConfig) -> Ledger:
    """Moments after the rows of some classes have changed: those of their former
    and of their new rows are taken, no other row is read. Decay and balance
    change every row's weight, so they need a full pass."""
    former = model.ledger
    if former is None or former.changes >= REBUILD or config.balance_power or config.decay:
        return ledger_of(support, config)
    own = F.col("label").isin(changed)
    return former.changed(Ledger.of(model.support.where(own)), Ledger.of(support.where(own)))


def projected(ledger: Ledger, config: ModelConfig, former: Projection | None = None) -> Projection:
    """The projection that the support's scatters give."""
    total, within = ledger.scatters()
    if config.projection == "pca":
        found = maps.pca(total, config.projection_width)
    elif config.projection == "random":
        found = maps.random_projection(len(ledger.s1), config.projection_width, config.seed)
    else:
        found = maps.soft_null(total, within, config.projection_width, config.range_share, config.null_share, config.ridge)
    if former is not None and config.warm_start:
        found = Projection(maps.warm_start(found.matrix, former.matrix, config.warm_start), found.mode, found.spectrum)
    return found


def resolved(support: DataFrame, z: DataFrame, projection: Projection, config: ModelConfig, tau: float, rho: float) -> prototypes.Scales:
    """Thresholds of a geometry (support rows, and z of the same rows); `rho` is
    the median radius of its prototypes."""
    if config.scale_mode == "absolute":
        return prototypes.scales(config.factors, tau, True, 1, 1, 1, 1, 1)
    radius = 1.0
    if config.local_affine:
        centers = mean_vectors(support, ["unit_id"], "phi", "w")
        radius = prototypes.median_radius(prototypes.distances(support, centers, ["unit_id"], "phi"), ["unit_id"])
    near = prototypes.median_nearest(z, "seq", "z")
    positive = projection.spectrum[projection.spectrum > 0]
    small = float(np.median(positive)) if len(positive) else near**2
    return prototypes.scales(config.factors, tau, False, radius, near, rho or near, float(projection.spectrum.max(initial=0.0)) or near**2, small)


def bank_of(support: DataFrame, projection: Projection, config: ModelConfig, tau: float, version: int = 0) -> tuple[Bank, prototypes.Scales, tuple[np.ndarray, np.ndarray] | None]:
    """Prototypes of the support under a projection, the scales resolved from
    them, and the background if the mode takes one."""
    z = cut(project(support, projection.matrix))
    second = config.mode in ("mahalanobis", "ghost")
    made = prototypes.build(z, vector="z", weight="w", q=config.radius_quantile, fragile_below=config.fragile_below, second=second)
    behind = prototypes.background(z, "label", "z", "w") if config.mode == "relative_mahalanobis" else None
    many = support.select("unit_id").distinct().count() > prototypes.MAX_PROTOTYPES
    if many and config.teen is None:  # more than the driver takes; few-shot centres are drawn to a bank that it holds
        made = cut(made)
        found = resolved(support, z, projection, config, tau, exact_quantiles(made, ["rho"], [0.5])["rho"][0])
        return _bank_of_many(made, support, config, found.rho_floor, version), found, behind
    bank = Bank.of(made)
    found = resolved(support, z, projection, config, tau, float(np.median(bank.rho)))
    if config.teen and prototypes.FRAGILE in bank.status:
        bank = _drawn_to_base(bank, z, config)
    bank.rho = np.maximum(bank.rho, found.rho_floor)
    if config.squeeze and version == 0:
        bank.rho = np.maximum(bank.rho * (1 - config.squeeze), found.rho_floor)
    if config.shrink:
        over = np.maximum(bank.weight / max(bank.weight.mean(), 1e-12) - 1, 0)
        bank.rho = np.where(over > 0, np.maximum(bank.rho / (1 + config.shrink * over), found.rho_floor), bank.rho)
    if config.dual is not None:
        wide = Bank.of(prototypes.build(support, vector="phi", weight="w", q=config.radius_quantile))
        bank.wide, bank.wide_rho = wide.centers, np.maximum(wide.rho, found.rho_floor)
    if len(bank.ids) > config.bank_cap:
        bank = prototypes.capped(bank, config.bank_cap, support.sparkSession)
    return bank, found, behind


def _bank_of_many(made: DataFrame, support: DataFrame, config: ModelConfig, floor: float, version: int) -> Bank:
    """The bank of more units than reach the driver: radii are reckoned in the
    table as `bank_of` does in arrays, and closest pairs merge in tasks until the cap."""
    rho = F.greatest("rho", F.lit(floor))
    if config.squeeze and version == 0:
        rho = F.greatest(rho * (1 - config.squeeze), F.lit(floor))
    if config.shrink:
        mean = max(made.agg(F.avg("weight")).first()[0], 1e-12)
        over = F.greatest(F.col("weight") / mean - 1, F.lit(0.0))
        rho = F.when(over > 0, F.greatest(rho / (1 + config.shrink * over), F.lit(floor))).otherwise(rho)
    made = made.withColumn("rho", rho)
    if config.dual is not None:
        wide = prototypes.build(support, vector="phi", weight="w", q=config.radius_quantile)
        made = made.join(wide.select("prototype_id", F.col("center").alias("wide"), F.greatest("rho", F.lit(floor)).alias("wide_rho")), "prototype_id")
    return Bank.of(prototypes.capped_table(made, config.bank_cap))


def _drawn_to_base(bank: Bank, z: DataFrame, config: ModelConfig) -> Bank:
    """Fragile prototypes moved towards the stable ones of other classes that
    they are most like, their radii (and covariances) taken about the new centre."""
    share, temperature, k = config.teen
    stable = bank.only([i for i, s in enumerate(bank.status) if s == prototypes.STABLE])
    centers = bank.centers.copy()
    for i, status in enumerate(bank.status):
        if status == prototypes.FRAGILE and stable.ids:
            centers[i] = prototypes.blended_center(bank.centers[i], bank.weight[i], bank.labels[i], stable, k, share, max(config.fragile_below, 1.0), temperature)
    moved = z.sparkSession.createDataFrame([(u, c.tolist()) for u, c in zip(bank.ids, centers, strict=True)], "unit_id string, center array<double>")
    far = prototypes.distances(z, moved, ["unit_id"], "z")
    radii = {r["unit_id"]: r["q"] for r in prototypes.weighted_quantile(far, ["unit_id"], "d", "w", config.radius_quantile, "q").collect()}
    away = centers - bank.centers
    cov = None if bank.cov is None else bank.cov + away[:, :, None] * away[:, None, :]
    return replace(bank, centers=centers, rho=np.array([radii[u] for u in bank.ids]), cov=cov)


def calibration_scores(rows: DataFrame, bank: Bank, seq: str = "row_id", label: str = "label", vector: str = "z", rule: scoring.Rule | None = None) -> DataFrame:
    """kind, label, prototype_id, seq, score: each row's score (by the rule, else
    the normalised distance) against the stable prototypes of its own class (pos,
    or unk where it has none) and against the others (imp)."""
    sent = rows.sparkSession.sparkContext.broadcast((bank, rule or scoring.Rule()))

    def run(batches):
        bank, rule = sent.value
        usable = np.array([s in (prototypes.STABLE, prototypes.FRAGILE) for s in bank.status], bool)
        labels = np.array(bank.labels, object)
        sides: dict[str, list] = {}
        for batch in batches:
            x, of = matrix(batch.column(2)), np.array(batch.column(1).to_pylist(), object)
            out: tuple[list, ...] = ([], [], [], [], [])
            for c in sorted(set(of)):
                mine = np.flatnonzero(of == c)
                if c not in sides:
                    own, rest = np.flatnonzero(usable & (labels == c)), np.flatnonzero(usable & (labels != c))
                    among = [("pos" if len(own) else "unk", own if len(own) else rest), ("imp", rest if len(own) else own)]
                    sides[c] = [(kind, bank.only(list(k)), rule.only(list(k))) for kind, k in among if len(k)]
                for kind, some, how in sides[c]:
                    score, at, _ = scoring.evaluate(x[mine], some, how)
                    for column, values in zip(out, ([kind] * len(mine), [c] * len(mine), [some.ids[i] for i in at], batch.column(0).take(pa.array(mine)).to_pylist(), score.tolist()), strict=True):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.float64())], names=["kind", "label", "prototype_id", "seq", "score"])

    kept = rows.select(F.col(seq).cast("long").alias("s"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    return kept.mapInArrow(run, "kind string, label string, prototype_id string, seq long, score double")


def vote_scores(model: Model, rows: DataFrame) -> DataFrame:
    """The same for votes: the distance of each row's furthest neighbour. Rows
    that are support (`own`, if there is such a column) do not vote for themselves."""
    own = "own" if "own" in rows.columns else None
    found = scoring.knn_vote(scoring.nearest_references(rows.withColumnRenamed("z", "x"), model.references(), model.config.knn, own=own))
    named = found.select(F.col("row_id").alias("seq"), F.col("label").alias("said"), "score").join(rows.select(F.col("row_id").alias("seq"), "label"), "seq")
    return named.select(F.when(F.col("said") == F.col("label"), "pos").otherwise("imp").alias("kind"), "label", F.lit(None).cast("string").alias("prototype_id"), "seq", "score")


def _multiplier(status: str, c: ModelConfig) -> float:
    return {prototypes.SINGLETON: c.single_multiplier, prototypes.PROVISIONAL: c.tiny_multiplier}.get(status, c.fragile_multiplier)


def calibrated(model: Model, rows: DataFrame) -> Model:
    """Thresholds from rows (row_id, label, z)."""
    c = model.config
    scores = cut(vote_scores(model, rows) if c.mode == "knn" else calibration_scores(rows, model.bank, rule=replace(model.rule(), mode="min_distance") if c.mode in ("evm", "ghost") else model.rule()))
    pos = cut(calibration.last(scores.where("kind = 'pos'"), ["label"], c.reservoir))
    neg = cut(calibration.reservoir(scores, "imp", c.reservoir).unionByName(calibration.reservoir(scores, "unk", c.reservoir)))
    tau = calibration.quantile(pos, c.tau_quantile, c.initial_tau)
    by_class: dict[str, float] = {}
    if c.threshold == "grid":
        tau = calibration.grid_search(pos, neg, c.alpha, c.beta, c.initial_tau, c.grid)
    elif c.threshold == "loco":
        tau = calibration.leave_one_out(pos, neg, c.alpha, c.beta, c.initial_tau)
    elif c.threshold in ("evt", "per_prototype"):
        tau = calibration.evt(pos, c.tail, 1 - c.alpha, c.beta, c.initial_tau)
    elif c.threshold == "per_class":
        by_class = {r["label"]: r["tau"] for r in calibration.by_class_quantile(pos, c.tau_quantile, tau).collect()}
    bank = replace(model.bank)
    if c.threshold == "per_prototype":
        local = calibration.by_prototype(pos.where("prototype_id IS NOT NULL"), c.tail, 1 - c.alpha, tau, c.fragile_multiplier, bank.ids)
        bank.local = np.array([local[i] for i in bank.ids])
    bank.override = np.array([np.nan if s == prototypes.STABLE else _multiplier(s, c) * tau for s in bank.status])
    weibull = calibration.weibull_by_class(pos, c.tail) if c.mode == "evm" else {}
    found = replace(model.scales, tau_sep=max(tau, c.separation * tau)) if model.scales and c.scale_mode == "relative" else model.scales
    return replace(model, tau=float(tau), by_class=by_class, weibull=weibull, bank=bank, scales=found)


def fit(train: DataFrame, held: DataFrame, config: ModelConfig | None = None, label: str = "label", key: str = "row_id", ignore: tuple[str, ...] = (), numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> Model:
    """Fit on labelled training rows, calibrate on held-out ones; both have
    `key` and `label`, all other columns but `ignore` are features, numbers or
    categories by their type unless they are named."""
    with scope(train.sparkSession) as own:
        model = _fit(train, held, config or ModelConfig(), label, key, ignore, numeric, categorical)
        own.keep(*_frames(model))
    return model


def _frames(model: Model) -> list[DataFrame | None]:
    """What a model reads later."""
    return [model.support, model.held, model.archive, None if model.index is None else model.index.members]


def _fit(train: DataFrame, held: DataFrame, config: ModelConfig, label: str, key: str, ignore: tuple[str, ...], numeric: tuple[str, ...], categorical: tuple[str, ...]) -> Model:
    features = train.drop(key, *ignore)
    schema = preprocess.infer_schema(features, label, numeric, categorical)
    fitted = preprocess.fit(features, schema, config.scaler)
    ids = (key, label)
    named = lambda df: df.withColumnsRenamed({key: "row_id", label: "label"}).withColumn("row_id", F.col("row_id").cast("long"))
    x = cut(named(preprocess.transform(train, fitted, ids)))
    width = len(fitted.names)
    before = None
    if config.pre_whitening:
        before = _whitening(x, "x")
        x = cut(maps.apply(x, Map("identity", width, before=before), "x", "y").drop("x").withColumnRenamed("y", "x"))
    gamma = gamma_of(x, config.gamma, config.seed) if config.map_kind != "identity" else 1.0
    marks = maps.supervised_landmarks(x, config.map_width, seed=config.seed) if config.map_kind == "nystrom" else None
    mapped = maps.fit(config.map_kind, width, config.map_width, gamma, config.seed, marks)
    phi = cut(maps.apply(x, mapped).drop("x"))
    if config.post_whitening:
        mapped.after = _whitening(phi, "phi")
        phi = cut(maps.apply(phi, Map("identity", len(mapped.after), after=mapped.after), "phi", "p").drop("phi").withColumnRenamed("p", "phi"))
    mapped.before = before
    support = by_class(build_support(phi, config))
    check_budgets(support, config)
    ledger = ledger_of(support, config)
    projection = projected(ledger, config)
    bank, found, behind = bank_of(support, projection, config, config.initial_tau)
    model = Model(config, fitted, mapped, support, projection, bank, config.initial_tau, scales=found, background=behind, ledger=ledger)
    kept = cut(named(featurise(held, fitted, mapped, ids)))
    model = calibrated(model, cut(project(kept, projection.matrix).drop("phi")))
    model.held = cut(admission.trim(kept, ["label"], config.reservoir, "latest", "row_id"))
    model.exemplars = _exemplars(support, config)
    return model


def rescored(model: Model, **changes) -> Model:
    """The same support and projection under other settings of prototypes,
    scores and thresholds, calibrated on the rows that were kept for it."""
    c = model.config.with_(**changes)
    bank, found, behind = bank_of(model.support, model.projection, c, c.initial_tau, model.version)
    out = replace(model, config=c, bank=bank, scales=found, background=behind, index=model.index if c.knn == model.config.knn else None)
    return calibrated(out, cut(project(model.held, model.projection.matrix).drop("phi")))


def check_budgets(support: DataFrame, config: ModelConfig) -> None:
    """Classes, units and rows of a unit within their budgets, else an error."""
    sizes = support.groupBy("unit_id", "label").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count_distinct("label").alias("classes"), F.count(F.lit(1)).alias("units"), F.max("n").alias("unit_rows")).first()
    counts = {k: row[k] or 0 for k in ("classes", "units", "unit_rows")}
    if over := admission.over_budget(counts, {"classes": config.max_classes, "units": config.max_units, "unit_rows": config.unit_rows}):
        raise ValueError(f"over budget: {over} of {counts}")


def _whitening(rows: DataFrame, vector: str) -> np.ndarray:
    n, s1, s2 = prototypes.moments(rows, vector)
    groups = [(r["n"], np.array(r["s1"])) for r in vector_sums(rows, ["label"], vector).where("rows >= 2").collect()]
    if not groups:
        return np.eye(len(s1))
    _, within = prototypes.scatters(n, s1, s2, groups)
    return maps.whitening(within, n)


def _exemplars(support: DataFrame, config: ModelConfig) -> tuple[np.ndarray, list[str]]:
    """A bounded, balanced memory of support rows for validating refreshes."""
    from lodestar.operators.splits import support as first_rows

    classes = support.select("label").distinct().count()
    rows = first_rows(support, "label", "seq", max(1, config.validation_rows // max(1, classes)), config.seed).collect()
    return np.array([r["phi"] for r in rows], float), [r["label"] for r in rows]


def ready(model: Model) -> None:
    """A model that predicts has prototypes, a projection as wide as its map, and
    what its mode reads."""
    if not model.bank.ids:
        raise ValueError("the model has no prototypes")
    if model.projection.matrix.shape[1] != model.bank.centers.shape[1]:
        raise ValueError("projection and prototypes differ in width")
    if model.config.mode == "relative_mahalanobis" and model.background is None:
        raise ValueError("the model has no background")


def predict(model: Model, df: DataFrame, key: str = "row_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Kept columns and the scorer's, the label `unknown` for rejected rows."""
    ready(model)
    z = project(featurise(df, model.fitted, model.map, (key, *keep)), model.projection.matrix)
    if model.config.mode == "knn":
        found = scoring.predict_by_vote(z, model.references(), model.bank, model.config.knn, model.tau, key, "z", model.by_class, keep)
    else:
        found = scoring.predict(z, model.bank, model.rule(), model.tau, key, "z", model.by_class, "phi" if model.config.dual is not None else None, keep)
    found = found.withColumn("predicted_label", F.coalesce("predicted_label", F.lit(UNKNOWN)))
    return found.withColumn("projection_version", F.lit(model.version))


@dataclass(frozen=True)
class Route:
    """From aligned features to a member's projected vectors."""

    map: Map
    matrix: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.matrix


def predict_members(models: list[Model], df: DataFrame, key: str = "row_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """`predict` of every model with `member`. Models of one preprocessor read
    and prepare the rows once, and all score them as they pass; votes and the
    blend of two spaces need passes of their own."""
    together = all(m.config.mode != "knn" and m.config.dual is None and m.fitted == models[0].fitted for m in models)
    if not together:
        parts = [predict(m, df, key, keep).withColumn("member", F.lit(i)) for i, m in enumerate(models)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    members = []
    for m in models:
        ready(m)
        rule = m.rule()
        members.append(scoring.Member(Route(m.map, m.projection.matrix), m.bank, rule, scoring.thresholds(m.bank, rule, m.tau, m.by_class), m.version))
    found = scoring.predict_members(preprocess.transform(df, models[0].fitted, (key, *keep)), members, key, "x", keep)
    return found.withColumn("predicted_label", F.coalesce("predicted_label", F.lit(UNKNOWN)))


def predict_one(model: Model, spark: SparkSession, sample: dict, label: str = "label") -> dict:
    """The prediction of one sample, a mapping of its features; its label, if it
    has one, is not looked at."""
    if not isinstance(sample, dict) or not sample:
        raise ValueError("one sample is a mapping of features")
    one = {k: v for k, v in sample.items() if k != label}
    kinds = {**dict.fromkeys(model.fitted.schema.numeric, "double"), **dict.fromkeys(model.fitted.schema.categorical, "string")}
    cast = {"double": float, "string": str}
    names = [c for c in kinds if c in one]
    values = tuple(None if one[c] is None else cast[kinds[c]](one[c]) for c in names)
    row = spark.createDataFrame([(0, *values)], ", ".join(["row_id long", *(f"`{c}` {kinds[c]}" for c in names)]))
    return predict(model, row).first().asDict()


def support_rows(model: Model, df: DataFrame, label: str = "label", key: str = "row_id") -> DataFrame:
    """Labelled rows as row_id, label, phi."""
    return featurise(df, model.fitted, model.map, (key, label)).select(F.col(key).cast("long").alias("row_id"), F.col(label).cast("string").alias("label"), "phi")


def admit(model: Model, df: DataFrame, label: str = "label", key: str = "row_id") -> tuple[Model, dict[str, str]]:
    """Provisional admission of a few labelled rows: one prototype for each
    chunk of `tiny_rows` of a class, if it keeps its distance from the other
    classes. Returns each class's outcome."""
    rows = support_rows(model, df, label, key).limit(MAX_ADMITTED + 1).collect()
    if len(rows) > MAX_ADMITTED:
        raise ValueError(f"over {MAX_ADMITTED} rows to admit; refresh takes them")
    rows.sort(key=lambda r: (r["label"], r["row_id"]))
    out, bank, outcome = replace(model), model.bank, {}
    w, c = model.projection.matrix, model.config
    for name in sorted({r["label"] for r in rows}):
        own = np.array([r["phi"] for r in rows if r["label"] == name], float)
        drop = [i for i, (x, s) in enumerate(zip(bank.labels, bank.status, strict=True)) if not (x == name and s in prototypes.TEMPORARY)]
        bank = bank.only(drop)
        parts = [own[i : i + c.tiny_rows] for i in range(0, len(own), c.tiny_rows)]
        if not c.keep_chunks:
            parts = parts[-1:]
        made = Bank([], [], np.zeros((0, w.shape[1])), np.zeros(0), np.zeros(0), [])
        floor = model.scales.rho_floor if model.scales else 1e-6
        for i, part in enumerate(parts):
            status = prototypes.SINGLETON if len(part) == 1 else prototypes.PROVISIONAL
            made = made.plus(_provisional(f"provisional:{name}:{i}", name, part, w, floor, c, model.tau * (c.single_multiplier if len(part) == 1 else c.tiny_multiplier), status))
        if blocked := _blocked(model, made, bank, {name: own}, max(c.tiny_separation * model.tau, model.tau)):
            outcome[name] = blocked
            continue
        bank, outcome[name] = bank.plus(made), "provisional"
    out.bank = bank
    out.log = model.log + [{"label": k, "status": v, "version": model.version} for k, v in outcome.items()]
    return out, outcome


def _provisional(name: str, label: str, phi: np.ndarray, w: np.ndarray, floor: float, c: ModelConfig, tau: float, status: str) -> Bank:
    """A prototype of a few rows and its threshold, with all that any mode reads."""

    def radius(rows: np.ndarray) -> float:
        far = np.sort(np.linalg.norm(rows - rows.mean(0), axis=1))
        return max(float(far[max(0, int(np.ceil(c.radius_quantile * len(far))) - 1)]), floor)

    z = phi @ w
    away = z - z.mean(0)
    return Bank([name], [label], z.mean(0)[None, :], np.array([radius(z)]), np.array([float(len(z))]), [status], np.array([tau]), np.array([np.nan]), (away.T @ away / len(z))[None], np.array([float(len(z))]), phi.mean(0)[None, :], np.array([radius(phi)]))


def _blocked(model: Model, made: Bank, bank: Bank, own: dict[str, np.ndarray], tau_sep: float) -> str | None:
    """Why candidates may not be served, none if they may: too close to another
    class, or in the hull of one of its nearest units."""
    c = model.config
    if not admission.passes_margin(made, bank, tau_sep, model.scales.eta_margin if model.scales else 0.0):
        return "blocked_by_margin"
    if c.local_affine:
        outlines = admission.Outlines.of(model.support)
        most = model.scales.eps_aff_local
        for label, rows in own.items():
            center = rows.mean(0)
            near = outlines.near(center, float(np.linalg.norm(rows - center, axis=1).max()), label, most, c.shortlist)
            units = {r["unit_id"]: (r["label"], np.array(r["phi"])) for r in model.support.where(F.col("unit_id").isin(near)).groupBy("unit_id", "label").agg(F.collect_list("phi").alias("phi")).collect()} if near else {}
            if admission.affine_conflict(rows, label, units, most):
                return "blocked_by_affine_screen"
    return None


def admit_cluster(model: Model, df: DataFrame, item: str, label: str = "label", key: str = "row_id") -> tuple[Model, dict[str, str]]:
    """Provisional admission of a larger pending item: its rows are localised
    into units of their own, each unit a prototype, and a class is served if all
    of them keep their distance."""
    c = model.config
    rows = cut(support_rows(model, df, label, key))
    placed = cut(build_support(rows, c))
    out, bank, outcome = replace(model), model.bank, {}
    if placed.count() > MAX_ADMITTED:
        raise ValueError(f"over {MAX_ADMITTED} rows to admit; refresh takes them")
    units: dict[tuple[str, str], list] = {}
    for r in placed.collect():
        units.setdefault((r["label"], r["unit_id"]), []).append(r["phi"])
    for name in sorted(x["label"] for x in rows.select("label").distinct().collect()):
        bank = bank.only([i for i, (x, s) in enumerate(zip(bank.labels, bank.status, strict=True)) if not (x == name and s in prototypes.TEMPORARY)])
        own = {u: np.array(phi, float) for (x, u), phi in units.items() if x == name}
        if not own:
            outcome[name] = "pending"
            continue
        made = Bank([], [], np.zeros((0, model.projection.matrix.shape[1])), np.zeros(0), np.zeros(0), [])
        for u, phi in sorted(own.items()):
            made = made.plus(_provisional(f"item:{item}:{u}", name, phi, model.projection.matrix, model.scales.rho_floor, c, model.tau * c.cluster_multiplier, prototypes.PROVISIONAL))
        if blocked := _blocked(model, made, bank, {name: np.vstack(list(own.values()))}, model.scales.tau_sep):
            outcome[name] = blocked
            continue
        bank, outcome[name] = bank.plus(made), "provisional"
    out.bank = bank
    out.log = model.log + [{"label": k, "status": v, "item": item, "version": model.version} for k, v in outcome.items()]
    return out, outcome


def archive_class(model: Model, label: str) -> Model:
    """A class out of service: its support moves to the archive, prototypes and
    thresholds go; what else is deployed stays as it is."""
    own = F.col("label") == label
    moved = model.support.where(own)
    archived = cut(moved if model.archive is None else model.archive.where(~own).unionByName(moved))
    bank = model.bank.only([i for i, x in enumerate(model.bank.labels) if x != label])
    thresholds = {k: v for k, v in model.by_class.items() if k != label}
    ledger = None if model.ledger is None or model.config.balance_power else model.ledger.changed(Ledger.of(moved), None)
    return replace(model, support=by_class(model.support.where(F.col("label").isNull() | ~own)), archive=archived, bank=bank, by_class=thresholds, index=None, ledger=ledger, log=[*model.log, {"label": label, "status": "archived", "version": model.version}])


def retained(model: Model, labels: list[str], now: float) -> DataFrame:
    """Decayed support of classes: the active one, else the archived one."""
    c = model.config
    rows = model.support.where(F.col("label").isin(labels))
    if model.archive is not None and c.rehydrate:
        missing = sorted(set(labels) - set(model.classes))
        rows = rows.unionByName(model.archive.where(F.col("label").isin(missing)))
    return admission.decayed(rows, now, c.decay, c.drop_below)


def fitted_to_budget(model: Model, wanted: list[str]) -> Model:
    """Classes archived, those of least support first, until `wanted` fit in."""
    while len(set(model.classes) | set(wanted)) > model.config.max_classes:
        weights = model.support.groupBy("label").agg(F.sum("w").alias("weight"))
        victim = admission.archive_victim(weights, wanted).first()
        if victim is None:
            raise ValueError("over budget: no class is left to archive")
        model = archive_class(model, victim["label"])
    return model


def refresh(model: Model, df: DataFrame, now: float = 0.0, force: tuple[str, ...] = (), label: str = "label", key: str = "row_id") -> Model:
    """Consolidate labelled rows: touched classes are localised again from what
    they retain and what is new, conflicts are reviewed, the geometry and the
    thresholds are rebuilt from support, and the version goes up."""
    with scope(df.sparkSession) as own:
        out = _refresh(model, df, now, force, label, key)
        own.keep(*_frames(out))
    return out


def _refresh(model: Model, df: DataFrame, now: float, force: tuple[str, ...], label: str, key: str) -> Model:
    c, spark = model.config, df.sparkSession
    new = cut(support_rows(model, df, label, key))
    touched = sorted(r["label"] for r in new.select("label").distinct().collect())
    model = fitted_to_budget(model, touched)
    kept_rows = admission.decayed(model.support, now, c.decay, c.drop_below)
    top = model.support.agg(F.max("seq")).first()[0] or 0
    if model.archive is not None:
        top = max(top, model.archive.agg(F.max("seq")).first()[0] or 0)
    old = retained(model, touched, now).select(F.col("seq").alias("row_id"), "label", "phi")
    fresh = new.withColumn("row_id", F.col("row_id") + top + 1)
    # A class with too few rows for a unit keeps them as they are, so few-shot classes are deployed.
    config = c.with_(residual="preserve") if c.residual == "drop" else c
    rebuilt = cut(build_support(cut(old.unionByName(fresh)), config, now))
    accepted = list(touched)
    while True:
        kept = kept_rows.where(~F.col("label").isin(touched)).unionByName(rebuilt.where(F.col("label").isin(accepted)) if accepted else spark.createDataFrame([], SUPPORT))
        blocked_back = [x for x in touched if x not in accepted]
        if blocked_back:
            kept = kept.unionByName(kept_rows.where(F.col("label").isin(blocked_back)))
        support = by_class(kept)
        conflicts = _review(support, accepted, c, model.scales) - set(force)
        left = [x for x in accepted if x not in conflicts]
        if left == accepted or c.refresh == "single_pass" and blocked_back:
            break
        accepted = left
    check_budgets(support, c)
    ledger = ledger_after(model, support, accepted, c)
    projection = projected(ledger, c, model.projection)
    bank, found, behind = bank_of(support, projection, c, model.tau, model.version + 1)
    out = replace(model, support=support, projection=projection, bank=bank, scales=found, background=behind, version=model.version + 1, index=None, ledger=ledger)
    if c.refresh_allowance is not None and model.exemplars and len(model.exemplars[1]):
        before, after = (_exemplar_accuracy(m) for m in (model, out))
        if after < before - c.refresh_allowance:
            bank, found, behind = bank_of(support, model.projection, c, model.tau, model.version + 1)
            out = replace(out, projection=model.projection, bank=bank, scales=found, background=behind)
    out.exemplars = _exemplars(support, c)
    if model.archive is not None:
        out.archive = cut(model.archive.where(~F.col("label").isin(out.classes)))
    source = support.select(F.col("seq").alias("row_id"), "label", "phi", F.lit(True).alias("own"))
    if c.refresh_calibration == "held" and model.held is not None:  # support only of classes that have no held rows
        source = source.join(model.held.select("label").distinct(), "label", "left_anti").select("row_id", "label", "phi", "own").unionByName(model.held.select("row_id", "label", "phi", F.lit(False).alias("own")))
    out = calibrated(out, cut(project(source, out.projection.matrix).drop("phi")))
    out.log = model.log + [{"label": x, "status": "consolidated" if x in accepted else "blocked", "version": out.version} for x in touched]
    return out


def _review(support: DataFrame, accepted: list[str], config: ModelConfig, found: prototypes.Scales | None) -> set[str]:
    """Accepted classes in affine conflict with any class."""
    if not accepted or not config.local_affine:
        return set()
    most = found.eps_aff_global if found else config.affine_global
    return set(admission.conflicting_classes(support, accepted, most))


def _exemplar_accuracy(model: Model) -> float:
    x, labels = model.exemplars
    _, _, at = scoring.evaluate(x @ model.projection.matrix, model.bank, scoring.Rule())
    return float(np.mean([model.bank.labels[i] == y for i, y in zip(at, labels, strict=True)]))
