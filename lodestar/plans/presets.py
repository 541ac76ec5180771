"""Published settings: the one configuration for every data set, the cells tuned
for each, and the protocol's seeds."""

from __future__ import annotations

from lodestar.plans.config import ExperimentConfig, ModelConfig

#: Seeds of the protocol, and the settings chosen for each data
#: set (threshold quantile, whitening after the map, support penalty, tie break,
#: bandwidth rule).
PROTOCOL_SEEDS = tuple(range(42, 52))
MODEL_SEED = 42
TUNED = {
    "toniot": (0.85, False, 0.20, False, "knn-10"),
    "nbaiot": (0.85, False, 0.20, False, "knn-50"),
    "cicids2018": (0.95, False, 0.0, True, "knn-5"),
    "5g_nidd": (0.99, False, 0.20, False, "knn-20"),
    "nsl_kdd": (0.85, False, 0.0, True, "median"),
    "edge_iiotset": (0.90, True, 0.20, False, "knn-20"),
    "ciciot2023_cat": (0.85, False, 0.0, False, "knn-5"),
}


def fixed(seed: int) -> ExperimentConfig:
    """The one configuration; `seed` is the protocol's, the model's is pinned."""
    return ExperimentConfig(ModelConfig(seed=MODEL_SEED), base_ratio=0.5, class_seed=seed)


def tuned(dataset: str, seed: int) -> ExperimentConfig:
    """The configuration chosen for one data set."""
    q, whiten, penalty, tie, gamma = TUNED[dataset]
    model = ModelConfig(seed=MODEL_SEED, tau_quantile=q, post_whitening=whiten, penalty=("log", penalty) if penalty else None, tie_break=0.85 if tie else None, gamma=gamma)
    return ExperimentConfig(model, base_ratio=0.5, class_seed=seed)
