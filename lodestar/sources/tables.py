"""Labelled tables, manifests, result sinks and resumable logs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.labels import LABEL_CANDIDATES, clean_headers, label_column, normalized
from lodestar.functions.session import cut
from lodestar.operators.running import running

if TYPE_CHECKING:
    from lodestar.sources.configs import DataConfig

SPLITS = ("train", "calibration", "test")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, row_id: str | None = None, bad: str | None = None) -> DataFrame:
    """A CSV with header, its names cleaned of byte-order mark and blanks.
    Without a schema all columns are text. With `row_id`, rows are numbered in
    order of file and place; with `bad`, that column has the whole line of a
    row that does not fit the header or the schema, and null in all others."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if bad:
        kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema) if schema else reader.csv(path).schema
        schema = T.StructType([*kind.fields, T.StructField(bad, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("enforceSchema", True)
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return in_file_order(rows, row_id) if row_id else clean_headers(rows)


def in_file_order(rows: DataFrame, row_id: str) -> DataFrame:
    """The rows of a file scan with their number in order of file name and place
    in the file, from 0, however the files are split and packed into tasks.

    A task reads a split from its start to its end, so within a split Spark's
    rising ids are in file order; splits are told by file and offset. The rows
    are materialised once, counted by split, and each split starts where those
    before it end. Only counts of splits are ordered, no row is."""
    at = rows.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("_split"), "*")
    named = clean_headers(at).withColumn("_place", F.monotonically_increasing_id())
    placed = cut(named)
    splits = placed.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_least"))
    before = running(splits, [], [F.col("_split")], {"_upto": F.col("_n")})
    first = before.select(F.col("_split").alias("_own"), (F.col("_upto") - F.col("_n") - F.col("_least")).alias("_shift"))
    return placed.join(first, F.col("_split") == F.col("_own")).withColumn(row_id, F.col("_place") + F.col("_shift")).select(row_id, *(c for c in named.columns if not c.startswith("_split") and c != "_place"))


def labelled(df: DataFrame, candidates: tuple[str, ...] = LABEL_CANDIDATES, drop: tuple[str, ...] = (), numbers: bool = False) -> DataFrame:
    """Label column found, renamed `label` and normalised; unwanted columns
    dropped; with `numbers`, text columns that are numbers throughout cast."""
    found = label_column(df.columns, candidates)
    out = df.withColumnRenamed(found, "label").drop(*(c for c in drop if c in df.columns))
    out = out.withColumn("label", normalized(F.col("label")))
    return as_numbers(out, number_columns(out)) if numbers else out


def number_columns(df: DataFrame, label: str = "label") -> list[str]:
    """Text columns all of whose values are numbers."""
    text = [f.name for f in df.schema.fields if f.name != label and isinstance(f.dataType, T.StringType)]
    if not text:
        return []
    bad = df.agg(*(F.sum((F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).cast("long")).alias(str(i)) for i, c in enumerate(text))).first()
    return [c for i, c in enumerate(text) if not bad[i]]


def as_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that are there as doubles; what is no number is null."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in columns if c in df.columns})


def profile(df: DataFrame, label: str = "label") -> DataFrame:
    """label (null included), rows: the histogram of a table's labels."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


@dataclass(frozen=True)
class Manifest:
    """Where a data set's splits are; relative paths start at its own folder."""

    name: str
    splits: dict[str, str]
    episode_split: str = "test"

    def __post_init__(self):
        if self.episode_split not in self.splits:
            raise ValueError(f"no split {self.episode_split!r}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest:
        from lodestar.sources.configs import read_mapping

        given = read_mapping(spark, path)
        home = path.rpartition("/")[0]
        where = lambda p: p if "://" in p or p.startswith("/") else f"{home}/{p}"
        return cls(given["name"], {k: where(v) for k, v in given["splits"].items()}, given.get("episode_split", "test"))

    def scan(self, spark: SparkSession, split: str, row_id: str | None = None) -> DataFrame:
        """A split as it is stored: CSV as text, in file order if `row_id` is
        named and the file does not have it, or Parquet."""
        path = self.splits[split]
        if path.rstrip("/").endswith(".csv"):
            rows = read_csv(spark, path)
            return rows if row_id is None or row_id in rows.columns else read_csv(spark, path, row_id=row_id)
        rows = spark.read.parquet(path)
        return rows if row_id is None or row_id in rows.columns else in_file_order(rows, row_id)

    def read(self, spark: SparkSession, split: str, data: DataConfig | None = None, first: str = "train") -> DataFrame:
        """A split with its label and typed columns. Which text columns are
        numbers is decided on the split `first`, so all splits agree."""
        return self.read_all(spark, data, (split,), first)[split]

    def read_all(self, spark: SparkSession, data: DataConfig | None = None, names: tuple[str, ...] = SPLITS, first: str = "train", row_id: str | None = None) -> dict[str, DataFrame]:
        from lodestar.sources.configs import DataConfig

        data = data or DataConfig()
        first = first if first in self.splits else names[0]
        parts = {n: data.read(self.scan(spark, n, row_id)) for n in dict.fromkeys((first, *names))}
        numbers = data.numbers(parts[first].drop(*([row_id] if row_id else [])))
        typed = {n: data.typed(parts[n], numbers) for n in names}
        return {n: p.withColumn(row_id, F.col(row_id).cast("long")) if row_id else p for n, p in typed.items()}


def write_splits(df: DataFrame, folder: str, split: str = "split", fmt: str = "parquet") -> None:
    """One folder for each split; rows without a split are left out."""
    for name in SPLITS:
        part = df.where(F.col(split) == name).drop(split)
        part.write.mode("overwrite").option("header", True).format(fmt).save(f"{folder}/{name}")


def write_predictions(df: DataFrame, folder: str, session: str = "session_id") -> None:
    df.write.mode("overwrite").partitionBy(session).parquet(folder)


def append_event(spark: SparkSession, path: str, event: str, payload: dict) -> None:
    """One line of sorted JSON with a UTC stamp."""
    line = json.dumps({"event": event, "at": datetime.now(UTC).isoformat(), **payload}, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def finished(events: DataFrame, tag: str = "tag", status: str = "status", order: str = "seq") -> DataFrame:
    """Of each tag the last row whose status is ok; broken lines (null tag) are
    left out."""
    last = Window.partitionBy(tag).orderBy(F.desc(order))
    good = events.where((F.col(status) == "ok") & F.col(tag).isNotNull())
    return good.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log, lines that do not parse dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_run(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of all sessions of a run; the session comes from the path."""
    kind = "true_label string, predicted_label string, accepted boolean, score double, threshold double"
    rows = spark.read.schema(kind).option("header", True).csv(f"{folder}/session_*")
    return rows.withColumn("session_id", F.regexp_extract(F.input_file_name(), r"session_(\d+)_", 1).cast("int"))


def run_scores(spark: SparkSession, folder: str, base: list[str], novel: list[str]) -> DataFrame:
    """Session metrics of a run's folder: session k knows the base classes and
    the first k novel ones."""
    from lodestar.operators.metrics import session_metrics

    known = [(k, x) for k in range(1, len(novel) + 1) for x in novel[:k]]
    return session_metrics(read_run(spark, folder), base, spark.createDataFrame(known, "session_id int, label string"))


def write_session(found: DataFrame, scored: DataFrame, folder: str, session: int) -> None:
    """One session's predictions as CSV, under the name that `read_run` reads,
    and its metrics as JSON."""
    columns = ("true_label", "predicted_label", "accepted", "score", "threshold")
    found.select(*columns).write.mode("overwrite").option("header", True).csv(f"{folder}/session_{session}_predictions")
    scored.where(F.col("session_id") == session).coalesce(1).write.mode("overwrite").json(f"{folder}/metrics/session_{session}")


def with_ids(found: DataFrame, **ids: object) -> DataFrame:
    """Literal id columns before all others; a null text becomes empty."""
    first = [F.lit("" if v is None else v).alias(k) for k, v in ids.items()]
    return found.select(*first, *(c for c in found.columns if c not in ids))


def save_state(spark: SparkSession, path: str, name: str, state: object) -> None:
    """A state of a few matrices as one row of JSON."""
    body = state.save() if hasattr(state, "save") else json.dumps(asdict(state), default=str)
    spark.createDataFrame([(name, body)], "name string, body string").write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, name: str) -> str:
    return spark.read.parquet(f"{path}/{name}").first()["body"]
