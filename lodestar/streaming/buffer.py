"""Rejected rows in a bounded buffer, as micro-batches and as one query.

The buffer is a versioned table: each micro-batch, and each rescoring after a
refresh, commits the next version; versions that are superseded are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.session import cut
from lodestar.operators.splits import shuffled
from lodestar.sources.commits import Commit, Transaction, Versions

POLICIES = ("fifo", "reservoir")


def bounded(df: DataFrame, most: int, policy: str = "fifo", seq: str = "seq", seed: int = 0) -> DataFrame:
    """The last `most` rows, or a uniform draw by hashed priority that batches
    can repeat and merge."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    order = [F.desc(seq)] if policy == "fifo" else [shuffled(F.col(seq), seed), F.col(seq)]
    return df.orderBy(*order).limit(most)


def bounded_by(df: DataFrame, keys: list[str], most: int, seq: str = "seq") -> DataFrame:
    """The last `most` rows of each group."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq))))
    return ranked.where(F.col("_r") <= most).drop("_r")


class Buffer:
    """Versions of the buffer under one folder. A micro-batch is one transaction;
    its number is in the commit record, so a repeated batch changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str, most: int, policy: str = "fifo", seq: str = "seq", keep: int = 2):
        self.spark, self.schema, self.most, self.policy, self.seq, self.keep = spark, schema, most, policy, seq, keep
        self.versions = Versions(spark, path)

    def read(self, at: Commit | None = None) -> DataFrame:
        """The rows of a version, of the latest if none is given."""
        found = at or self.versions.latest()
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{found.data}/rows")

    def _replace(self, change: Callable[[DataFrame], DataFrame], batch: int | None, info: dict | None = None) -> Commit:
        def write(latest: Commit | None, made: Transaction) -> None:
            rows = change(self.read(latest) if latest else self.spark.createDataFrame([], self.schema))
            bounded(rows, self.most, self.policy, self.seq).write.parquet(f"{made.data}/rows")
            last = latest.info.get("batch", -1) if latest else -1
            made.info.update({"batch": last if batch is None else batch, **(info or {})})

        done = self.versions.update(write)
        self.versions.clean(self.keep)
        return done

    def add(self, rejects: DataFrame, batch_id: int) -> None:
        """The buffer with the new rejects of a batch, unless it has them."""
        latest = self.versions.latest()
        if latest is None or latest.info.get("batch", -1) < batch_id:
            self._replace(lambda old: old.unionByName(rejects.select(*old.columns)), batch_id)

    def rescore(self, score: Callable[[DataFrame], DataFrame], version: int | None = None) -> tuple[DataFrame, int]:
        """After a model has changed: rows that `score` (adds `accepted`) still
        rejects become the buffer, capped, in one transaction; also how many
        left it. `version` is the model's, kept in the commit record. Rows that a
        stream adds meanwhile are scored too."""
        sizes: dict[str, int] = {}

        def still(old: DataFrame) -> DataFrame:
            kept = cut(score(old).where(~F.col("accepted")).select(*old.columns))
            sizes["left"] = old.count() - kept.count()
            return kept

        done = self._replace(still, None, {} if version is None else {"model": version})
        return self.read(done), sizes["left"]


def start(stream: DataFrame, score: Callable[[DataFrame], DataFrame], buffer: Buffer, checkpoint: str, **trigger) -> StreamingQuery:
    """Score each micro-batch and keep its rejects in the buffer."""

    def step(batch: DataFrame, batch_id: int) -> None:
        buffer.add(score(batch).where(~F.col("accepted")), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_rejects(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and reject rates by event-time window, late rows within the
    watermark included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("accepted")).cast("double")).alias("reject_rate"))
