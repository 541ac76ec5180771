"""Exact dedup by a heavy-hitter split.

Each text becomes its SHA-256. Misra-Gries summaries, one for each partition
and mergeable by adding counters, name every digest that may hold at least
`share` of the rows. An exact count verifies them, and the rows that stay of
these few (at most 2 / share, whatever the data) are broadcast: their copies
are settled where they are read. All other digests are rare: an ordinary
shuffle adds up what each task has found of them, and joins it back.

Defined cases: a null text counts as empty. Of equal texts the row with the
largest id stays, a null id being smallest; of rows that repeat an id and its
text exactly one stays. Empty tables give empty results;
other columns are carried or ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, unique_name

#: A digest with this share of all rows is heavy.
SHARE = 1 / 1024


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def summaries(digests: DataFrame, counters: int) -> DataFrame:
    """Misra-Gries by partition: `counters` digests at most, each with a count
    that is short of the true one by under rows / counters."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in rows:
            found = pa.compute.value_counts(batch.column(0))
            for key, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                held[key] = held.get(key, 0) + n
            if len(held) > counters:  # as often as each set of counters + 1 different digests can be struck out
                less = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -counters - 1)[-counters - 1])
                held = {k: n - less for k, n in held.items() if n > less}
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.int64())], names=["digest", "n"])

    return digests.select("digest").mapInArrow(run, "digest binary, n long")


def heavy_digests(digests: DataFrame, share: float = SHARE) -> DataFrame:
    """digest, best (largest id and its row), n: exact, for every digest with at
    least `share` of the rows; 2 / share rows at most. `digests` has digest, id
    and row and is materialised."""
    rows = digests.count()
    # Each summary lacks under its rows * share / 2, so all sums together lack under rows * share / 2.
    candidates = summaries(digests, int(2 / share)).groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, rows * share / 2)).select("digest")
    return (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    )


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows)  # ids and digests only; `row` is fixed from here on
    heavy = cut(heavy_digests(rows, share))
    marked = rows.join(F.broadcast(heavy.select("digest", "best", "n")), "digest", "left")
    settled = marked.where(F.col("n").isNotNull())
    rare = marked.where(F.col("n").isNull()).select("digest", "id", "row")
    groups = rare.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    light = rare.join(groups, "digest").select(*marked.columns)
    return settled.unionByName(light).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows that stay, with their columns. Copies of heavy digests go where
    they are read; of the rest each task first keeps its own best row."""
    key, row = unique_name(df, "digest"), unique_name(df, "whole")
    named = df.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.lit(0).alias("row"))
    heavy = heavy_digests(cut(named), share).select(F.col("digest").alias("_heavy_digest"), F.col("best.id").alias("_heavy_id"))
    whole = df.select(digest(F.col(text_col)).alias(key), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(row))
    left = whole.join(F.broadcast(cut(heavy)), F.col(key) == F.col("_heavy_digest"), "left")
    left = left.where(F.col("_heavy_digest").isNull() | F.col(f"{row}.`{id_col}`").eqNullSafe(F.col("_heavy_id")))
    return left.groupBy(key).agg(F.max_by(F.col(row), F.struct(F.col(f"{row}.`{id_col}`"))).alias(row)).select(f"{row}.*")
