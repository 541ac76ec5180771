"""Settings from files, run names and data set descriptions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.labels import LABEL_CANDIDATES
from lodestar.plans.config import ExperimentConfig, ModelConfig


def unique(values: object) -> list[str]:
    """A list of texts without repeats, in order; nothing for null."""
    if values is None:
        return []
    if not isinstance(values, (list, tuple)) or not all(isinstance(v, str) for v in values):
        raise TypeError("a list of texts is wanted")
    return list(dict.fromkeys(values))


def run_id(name: str, at: datetime | None = None) -> str:
    """A stamp and a slug of the name: lower-case letters and digits, else a dash."""
    slug = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "run"
    return f"{(at or datetime.now(UTC)):%Y%m%d-%H%M%S}-{slug}"


def stamp(at: datetime | None = None) -> str:
    return (at or datetime.now(UTC)).replace(microsecond=0).isoformat().replace("+00:00", "Z")


@dataclass(frozen=True)
class DataConfig:
    """What a data set's columns are: the label and its other names, what is
    dropped, and what counts as a number or a category against its type."""

    label: str = "label"
    aliases: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    def __post_init__(self):
        for f in ("aliases", "drop", "numeric", "categorical"):
            object.__setattr__(self, f, tuple(unique(list(getattr(self, f) or []))))
        if both := sorted(set(self.numeric) & set(self.categorical)):
            raise ValueError(f"numeric and categorical both name {both}")

    @property
    def candidates(self) -> tuple[str, ...]:
        """Label names in the order in which they are looked for."""
        return tuple(unique([self.label, *self.aliases, *LABEL_CANDIDATES]))

    def read(self, df: DataFrame) -> DataFrame:
        """The label found and normalised, unwanted columns dropped."""
        from lodestar.sources.tables import labelled

        return labelled(df, self.candidates, self.drop)

    def numbers(self, df: DataFrame) -> list[str]:
        """The text columns that are numbers: those named so, and those all of
        whose values are, unless they are named categorical."""
        from lodestar.sources.tables import number_columns

        missing = sorted((set(self.numeric) | set(self.categorical)) - set(df.columns))
        if missing:
            raise KeyError(f"no such columns: {missing}")
        return sorted((set(number_columns(df)) | set(self.numeric)) - set(self.categorical))

    def typed(self, df: DataFrame, numbers: list[str]) -> DataFrame:
        """Columns as numbers and categories, so that their types say what they are."""
        from lodestar.sources.tables import as_numbers

        return as_numbers(df, numbers).withColumns({c: F.col(f"`{c}`").cast("string") for c in self.categorical if c in df.columns})


@dataclass(frozen=True)
class RunConfig:
    """One experiment: its name, its data set, its settings and its folder."""

    name: str
    experiment: ExperimentConfig = field(default_factory=ExperimentConfig)
    data: DataConfig = field(default_factory=DataConfig)
    manifest: str | None = None
    output: str | None = None


def read_mapping(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML file that holds a mapping; YAML where its reader is installed."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ModuleNotFoundError:
            raise ValueError("YAML files need the yaml package; use JSON") from None
        given = yaml.safe_load(text)
    else:
        given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return given


def _of(kind: type, given: dict | None):
    given = dict(given or {})
    if unknown := sorted(set(given) - {f.name for f in fields(kind)}):
        raise ValueError(f"{kind.__name__} has no {unknown}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load_run(spark: SparkSession, path: str) -> RunConfig:
    """A run's settings from a file; names that do not exist are an error."""
    given = read_mapping(spark, path)
    experiment = dict(given.get("experiment") or {})
    model = _of(ModelConfig, experiment.pop("model", None))
    home = path.rpartition("/")[0]
    where = lambda p: p if p is None or "://" in p or p.startswith("/") else f"{home}/{p}"
    if unknown := sorted(set(given) - {f.name for f in fields(RunConfig)}):
        raise ValueError(f"RunConfig has no {unknown}")
    return RunConfig(given["name"], _of(ExperimentConfig, {**experiment, "model": model}), _of(DataConfig, given.get("data")), where(given.get("manifest")), where(given.get("output")))
