"""Settings of a model and of experiments, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


MODES = ("min_distance", "energy", "reciprocal", "hyperspherical", "evm", "mahalanobis", "relative_mahalanobis", "ghost", "knn")


@dataclass(frozen=True)
class ModelConfig:
    """Defaults are the deployed configuration."""

    scaler: str = "quantile"
    map_kind: str = "rff"
    map_width: int = 512
    gamma: float | str = "knn-20"
    seed: int = 42
    pre_whitening: bool = False
    post_whitening: bool = False
    neighbours: int = 5
    least_unit: int = 2
    residual: str = "drop"
    trim: str = "uniform"
    unit_rows: int = 256
    augment_below: int = 0
    projection: str = "soft_null"
    projection_width: int = 32
    range_share: float = 1e-8
    null_share: float = 1e-2
    ridge: float = 0.0
    balance_power: float = 0.0
    radius_quantile: float = 0.9
    radius_floor_share: float = 0.1
    fragile_below: float = 2.0
    fragile_multiplier: float = 0.8
    bank_cap: int = 5000
    squeeze: float = 0.0
    shrink: float = 0.0
    teen: tuple[float, float, int] | None = None
    mode: str = "min_distance"
    temperature: float = 1.0
    class_temperature: float = 0.0
    dual: float | None = None
    knn: int = 10
    adaptive_shrinkage: bool = True
    ghost_alpha: float = 0.05
    evm_threshold: float = 0.5
    reciprocal_weight: float = 0.5
    tie_break: float | None = 0.85
    penalty: tuple[str, float] | None = None
    threshold: str = "quantile"
    tau_quantile: float = 0.85
    alpha: float = 0.05
    beta: float = 0.9
    grid: int = 64
    reservoir: int = 512
    tail: int = 20
    initial_tau: float = 1.0
    scale_mode: str = "relative"
    margin: float = 1.0
    separation: float = 1.1
    tiny_separation: float = 1.25
    affine_local: float = 1.0
    affine_global: float = 2.0
    tiny_rows: int = 4
    tiny_multiplier: float = 0.7
    single_multiplier: float = 0.5
    cluster_multiplier: float = 0.85
    shortlist: int | None = 10
    local_affine: bool = False
    refresh: str = "single_pass"
    refresh_allowance: float | None = None
    refresh_calibration: str = "support"
    validation_rows: int = 200
    decay: float = 0.0
    drop_below: float = 0.0
    max_classes: int = 1000
    max_units: int = 1_000_000_000  # as published: units grow with the rows
    rehydrate: bool = True
    warm_start: float = 0.0
    keep_chunks: bool = True

    def __post_init__(self):
        def one_of(name: str, *values: object) -> None:
            if getattr(self, name) not in values:
                raise ValueError(f"{name} is one of {values}")

        one_of("scaler", "robust", "standard", "minmax", "power", "quantile")
        one_of("map_kind", "identity", "rff", "laplacian", "nystrom")
        one_of("residual", "drop", "preserve", "merge")
        one_of("trim", "latest", "head", "uniform", "leverage")
        one_of("projection", "soft_null", "pca", "random")
        one_of("mode", *MODES)
        one_of("scale_mode", "relative", "absolute")
        one_of("threshold", "quantile", "grid", "loco", "evt", "per_class", "per_prototype")
        one_of("refresh", "single_pass", "fixed_point", "off")
        one_of("refresh_calibration", "support", "held")
        for name in ("map_width", "neighbours", "least_unit", "unit_rows", "projection_width", "bank_cap", "reservoir", "tail", "tiny_rows", "knn"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} is at least 1")
        for name in ("tau_quantile", "alpha", "beta", "radius_quantile"):
            if not 0 < getattr(self, name) < 1:
                raise ValueError(f"{name} lies between 0 and 1")
        if self.dual is not None and not 0 <= self.dual <= 1:
            raise ValueError("dual is a share")
        if self.teen is not None and not (0 <= self.teen[0] <= 1 and self.teen[1] > 0 and self.teen[2] >= 1):
            raise ValueError("teen is a share, a temperature and a number of classes")

    @property
    def factors(self) -> dict[str, float]:
        """What the scales of a geometry are multiplied by."""
        return {"range": self.range_share, "null": self.null_share, "aff_local": self.affine_local, "aff_global": self.affine_global, "margin": self.margin, "rho": self.radius_floor_share, "sep": self.separation}

    def with_(self, **changes) -> ModelConfig:
        return replace(self, **changes)


#: Arms of the ablation: what each takes away.
ABLATIONS: dict[str, dict] = {
    "full": {},
    "no_tie_break": {"tie_break": None},
    "narrow_map": {"map_width": 128},
    "no_refresh": {"refresh": "off"},
    "energy": {"mode": "energy"},
}


@dataclass(frozen=True)
class ExperimentConfig:
    model: ModelConfig = field(default_factory=ModelConfig)
    base_ratio: float = 0.5
    shots: int = 5
    support_share: float = 1.0
    class_seed: int = 42
    random_base: bool = True
    novel_order: str = "sorted"

    def __post_init__(self):
        if not 0 < self.base_ratio < 1 or self.shots < 1 or not 0 < self.support_share <= 1:
            raise ValueError("base_ratio and support_share are shares, shots at least 1")
        if self.novel_order not in ("sorted", "random"):
            raise ValueError("novel_order is sorted or random")


@dataclass(frozen=True)
class TinyConfig:
    """Admission in bursts: ensemble, how often a refresh comes, and what changes
    once a class is consolidated."""

    experiment: ExperimentConfig = field(default_factory=ExperimentConfig)
    bursts: tuple[int, ...] = (1, 2, 5)
    episodes: int | None = None
    least_support: int = 1
    members: int = 1
    seed_step: int = 1
    aggregation: str = "average"
    refresh_every: int = 1
    promoted_refresh_every: int | None = None
    promoted_refresh: str | None = None
    promoted_trim: str | None = None
    promoted_affine: bool = False

    def __post_init__(self):
        if not self.bursts or min(self.bursts) < 1 or self.members < 1 or self.refresh_every < 1:
            raise ValueError("bursts, members and refresh_every are at least 1")
        if self.aggregation not in ("average", "max", "majority"):
            raise ValueError("aggregation is average, max or majority")

    def policy(self, promoted: bool) -> tuple[dict, int]:
        """Changes to the model's settings and bursts between refreshes, by
        whether the class is consolidated."""
        m = self.experiment.model
        changes = {"local_affine": m.local_affine, "refresh": m.refresh, "trim": m.trim}
        if not promoted:
            return changes, self.refresh_every
        changes["local_affine"] = m.local_affine or self.promoted_affine
        changes["refresh"] = self.promoted_refresh or m.refresh
        changes["trim"] = self.promoted_trim or m.trim
        return changes, self.promoted_refresh_every or self.refresh_every
