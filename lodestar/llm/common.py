"""Helpers shared by the training-data operators: the shared folder, file
systems that executors can reach, and tolerant column handling."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.session import cut, shared_dir, ship  # noqa: F401  (cut is handed on)

#: crc32(doc_id as text) mod FOLDS == HELD_OUT marks held-out rows.
FOLDS, HELD_OUT = 5, 0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def sized_broadcast(df: DataFrame, most: int) -> DataFrame:
    """A materialised side, broadcast if it has at most `most` rows; a larger
    one is left to an ordinary join."""
    return F.broadcast(df) if df.count() <= most else df


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def held_out(id_col: str = "doc_id"):
    """True for rows no model may learn from; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS) == HELD_OUT


def unique_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
