"""Saving and loading a fitted model, and what is told about its state."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, is_dataclass
from pathlib import PurePath

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import admission, metric, prototypes
from lodestar.operators.maps import Map, Projection
from lodestar.operators.preprocess import Fitted, Schema
from lodestar.operators.prototypes import Bank, Scales
from lodestar.plans.config import ModelConfig
from lodestar.plans.model import Model
from lodestar.sources.commits import Versions

FRAMES = ("support", "held", "archive")
#: Marks the list that stands for a number JSON does not know. No list of a model
#: has two texts of which the first is this.
NUMBER = "\x00number"


def plain(value: object) -> object:
    """A value as JSON can hold it: arrays and numpy numbers as Python's, tuples
    and sets as lists, paths and all else as text."""
    if is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, (set, frozenset)):
        return sorted(map(plain, value), key=str)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, np.generic):
        return plain(value.item())
    if isinstance(value, float) and not np.isfinite(value):
        return [NUMBER, str(value)]
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return value.as_posix() if isinstance(value, PurePath) else str(value)


def back(value: object) -> object:
    """The other way round, for numbers that JSON does not know."""
    if isinstance(value, dict):
        return {k: back(v) for k, v in value.items()}
    if isinstance(value, list):
        return float(value[1]) if len(value) == 2 and value[0] == NUMBER else [back(v) for v in value]
    return value


def fitted_of(given: dict) -> Fitted:
    """A preprocessor from its saved statistics."""
    s = given["schema"]
    schema = Schema(s["label"], tuple(s["numeric"]), tuple(s["categorical"]), tuple(s["order"]))
    return Fitted(**{**given, "schema": schema})


def save(model: Model, folder: str, keep: int = 1) -> int:
    """The whole model (but its moments, which a refresh makes anew) as the next
    version of a folder, and older versions than the last `keep` removed. Until its last byte is written the former version
    holds; a loaded model may be saved where it came from. Returns the version."""
    versions = Versions(model.support.sparkSession, folder)

    def write(_, made) -> None:
        for name in FRAMES:
            if (frame := getattr(model, name)) is not None:
                frame.write.parquet(f"{made.data}/{name}")
        if model.index is not None:
            model.index.save(f"{made.data}/index")
        small = {f.name: plain(getattr(model, f.name)) for f in fields(model) if f.name not in (*FRAMES, "index", "ledger")}
        small["frames"] = [n for n in FRAMES if getattr(model, n) is not None]
        small["indexed"] = model.index is not None
        write_json(model.support.sparkSession, f"{made.data}/model", small)

    done = versions.update(write)
    versions.clean(keep=max(1, keep))
    return done.version


def load(spark: SparkSession, folder: str, version: int | None = None) -> Model:
    """A model as it was saved, the latest version or a kept one; it predicts the
    same. A model whose folder is saved to again must be loaded again, unless
    that save keeps its version."""
    versions = Versions(spark, folder)
    found = versions.latest() if version is None else versions.get(version)
    if found is None:
        raise FileNotFoundError(folder)
    folder = found.data
    given = back(read_json(spark, f"{folder}/model"))
    array = lambda x: None if x is None else np.array(x, float)
    config = given["config"]
    tuples = {k: tuple(config[k]) for k in ("penalty", "teen") if config[k] is not None}
    b = given["bank"]
    width = len(given["projection"]["matrix"][0])
    bank = Bank(b["ids"], b["labels"], array(b["centers"]).reshape(len(b["ids"]), width), array(b["rho"]), array(b["weight"]), b["status"], array(b["override"]), array(b["local"]), *(array(b[k]) for k in ("cov", "rows", "wide", "wide_rho")))
    mapped = Map(**{k: array(v) if isinstance(v, list) else v for k, v in given["map"].items()})
    p = given["projection"]
    frames = {n: spark.read.parquet(f"{folder}/{n}") if n in given["frames"] else None for n in FRAMES}
    return Model(
        ModelConfig(**{**config, **tuples}), fitted_of(given["fitted"]), mapped, frames["support"], Projection(array(p["matrix"]), p["mode"], array(p["spectrum"])), bank, given["tau"],
        given["by_class"], {k: tuple(v) for k, v in given["weibull"].items()}, given["version"], given["log"],
        None if given["exemplars"] is None else (array(given["exemplars"][0]), given["exemplars"][1]), frames["held"],
        None if given["scales"] is None else Scales(**given["scales"]), None if given["background"] is None else tuple(map(array, given["background"])), frames["archive"],
        metric.Index.load(spark, f"{folder}/index") if given["indexed"] else None,
    )


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One file of sorted JSON under a folder, by Spark's own writer."""
    line = json.dumps(plain(value), sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).where(F.length("value") > 0).first()["value"])


def projection_meta(model: Model) -> dict:
    p = model.projection
    return {"mode": p.mode, "version": model.version, "width": int(p.matrix.shape[1]), "spectrum": plain(p.spectrum)}


def threshold_meta(model: Model) -> dict:
    """The scales in force with the threshold and how it was found."""
    return {**(asdict(model.scales) if model.scales else {}), "tau": float(model.tau), "calibration_mode": model.config.threshold}


def sanity(model: Model, pending: DataFrame | None = None, buffered: int = 0) -> dict:
    """Counters of a model's state; with pending items, of those too."""
    row = model.support.agg(F.count_distinct("label").alias("classes"), F.count_distinct("unit_id").alias("units"), F.sum("w").alias("weight")).first()
    out = {
        "active_class_count": row["classes"],
        "active_unit_count": row["units"],
        "total_weight": float(row["weight"] or 0),
        "prototype_count": len(model.bank.ids),
        "provisional_prototype_count": sum(s in prototypes.TEMPORARY for s in model.bank.status),
        "projection_mode": model.projection.mode,
        "projection_width": int(model.projection.matrix.shape[1]),
        "projection_version": model.version,
        "calibration_mode": model.config.threshold,
        "tau": float(model.tau),
        "buffered": buffered,
    }
    if pending is not None:
        p = pending.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("location") == "hot").cast("long")).alias("hot"), F.sum((F.col("location") == "archived").cast("long")).alias("archived")).first()
        out |= {"pending_count": p["n"], "hot_pending_count": p["hot"] or 0, "archived_pending_count": p["archived"] or 0}
    return out


def snapshot(models: Model | list[Model]) -> dict:
    """What an evaluation records of a model, or of an ensemble: labels of any
    member, prototypes of all, the mean threshold, the latest version."""
    if isinstance(models, list):
        each = [snapshot(m) for m in models]
        return {"calibration_mode": "ensemble", "known_labels": sorted({x for s in each for x in s["known_labels"]}), "projection_width": each[0]["projection_width"], "projection_mode": "ensemble", "projection_version": max(s["projection_version"] for s in each), "prototype_count": sum(s["prototype_count"] for s in each), "tau": float(np.mean([s["tau"] for s in each]))}
    return {"calibration_mode": models.config.threshold, "known_labels": models.classes, "projection_width": int(models.projection.matrix.shape[1]), "projection_mode": models.projection.mode, "projection_version": models.version, "prototype_count": len(models.bank.ids), "tau": float(models.tau)}


def metadata(models: Model | list[Model]) -> dict:
    """A snapshot with the members', the thresholds' and the projections' records."""
    members = models if isinstance(models, list) else [models]
    return {**snapshot(models), "members": [{"seed": m.config.seed, "mode": m.config.mode, "projection": projection_meta(m), "thresholds": threshold_meta(m), "log": plain(m.log)} for m in members]}


# --- pending items --------------------------------------------------------

ITEMS = "item_id string, label string, rows long, status string, location string, created_at double"


def cache_batch(model: Model, items: DataFrame | None, payloads: DataFrame | None, batch: DataFrame, batch_id: str, now: float, label: str = "label", key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Pending items (one for each class of the batch) and their payload rows:
    item_id, row_id, label, phi. What is there already stays as it is."""
    from lodestar.functions.session import cut
    from lodestar.plans.model import support_rows

    spark = batch.sparkSession
    items = items if items is not None else spark.createDataFrame([], ITEMS)
    rows = cut(support_rows(model, batch, label, key))
    now_items = cut(admission.cache_items(items, rows, batch_id, now).select(*[c.split(" ")[0] for c in ITEMS.split(", ")]))
    made = rows.withColumn("item_id", F.concat_ws(":", F.lit(batch_id), "label"))
    made = made.join(items.select("item_id"), "item_id", "left_anti").select("item_id", "row_id", "label", "phi")
    return now_items, cut(made if payloads is None else payloads.unionByName(made))


def payload(items: DataFrame, payloads: DataFrame, item_id: str) -> DataFrame:
    """Rows of one item, wherever it is kept; an unknown item is an error."""
    if not items.where(F.col("item_id") == item_id).limit(1).count():
        raise KeyError(item_id)
    return payloads.where(F.col("item_id") == item_id).drop("item_id")
