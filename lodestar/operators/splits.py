"""Balanced splits, session supports and bursts over a stable order.

Only the first rows of each class in that order matter. A count of each class by
the leading digits of the order tells where those end, exactly; only rows up to
there are ranked, so no task ranks a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.session import cut


def shuffled(key: Column, seed: int = 0) -> Column:
    """A reproducible order that does not follow the key's."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


#: Leading hexadecimal digits of the order by which classes are counted.
DIGITS = 3


def first_rows(df: DataFrame, label: str, key: str, most: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first `most` rows of each class in shuffled order with `rank`, and all
    other rows."""
    order = shuffled(F.col(key), seed)
    marked = df.withColumn("_o", order).withColumn("_d", F.substring("_o", 1, DIGITS))
    counted = marked.groupBy(label, "_d").agg(F.count(F.lit(1)).alias("_c"))  # at most 16 ** DIGITS rows a class
    upto = Window.partitionBy(label).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    started = counted.withColumn("_b", F.coalesce(F.sum("_c").over(upto), F.lit(0))).where(F.col("_b") < most)
    last = cut(started.groupBy(F.col(label).alias("_label")).agg(F.max("_d").alias("_last")))
    placed = marked.join(last, F.col(label).eqNullSafe(F.col("_label")))
    order_in = Window.partitionBy(label).orderBy("_o", key)
    near = placed.where(F.col("_d") <= F.col("_last")).withColumn("rank", F.row_number().over(order_in))
    first = near.where(F.col("rank") <= most).select(*df.columns, "rank")
    beyond = near.where(F.col("rank") > most).select(*df.columns)
    return first, placed.where(F.col("_d") > F.col("_last")).select(*df.columns).unionByName(beyond)


def balanced_split(df: DataFrame, label: str, key: str, cap: int, seed: int = 0, train: float = 0.6, calibration: float = 0.2) -> DataFrame:
    """Each row's split: of every class at most `cap` rows, the first 60 % train,
    the next 20 % calibration (rounded down), the rest test; rows beyond null."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("_n"))
    first, rest = first_rows(df, label, key, cap, seed)
    n_train, n_cal = F.floor(F.col("_n") * train), F.floor(F.col("_n") * calibration)
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_cal, "calibration").otherwise("test")
    taken = first.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).withColumn("split", split).select(*df.columns, "split")
    return taken.unionByName(rest.withColumn("split", F.lit(None).cast("string")))


def support(df: DataFrame, label: str, key: str, shots: int, seed: int = 0) -> DataFrame:
    """The first `shots` rows of each class in shuffled order, with `rank`."""
    return first_rows(df, label, key, shots, seed)[0]


def chunks(df: DataFrame, size: int) -> DataFrame:
    """Chunk numbers (from 0) of a ranked support."""
    return df.withColumn("chunk", F.floor((F.col("rank") - 1) / size).cast("int"))


def bursts(df: DataFrame, label: str, key: str, sizes: list[int], seed: int = 0) -> DataFrame:
    """Consecutive bursts of given sizes of each class, with `rank`; what is left
    over has neither."""
    first, rest = first_rows(df, label, key, sum(sizes), seed)
    burst, end = F.lit(None).cast("int"), sum(sizes)
    for i in reversed(range(len(sizes))):
        burst = F.when(F.col("rank") <= end, i).otherwise(burst)
        end -= sizes[i]
    none = F.lit(None).cast("int")
    return first.withColumn("burst", burst).unionByName(rest.withColumns({"rank": none, "burst": none}))


def plan_sessions(labels: list[str], base_ratio: float, shuffle=None, novel_order: str = "sorted") -> tuple[list[str], list[str]]:
    """Base and novel classes: at least one of each; `shuffle` orders the labels
    before they are parted, novel ones then come sorted or as they fell."""
    order = sorted(labels)
    if len(order) < 2:
        raise ValueError("needs two classes at least")
    if shuffle is not None:
        shuffle(order)
    n = min(max(int(len(order) * base_ratio), 1), len(order) - 1)
    return sorted(order[:n]), sorted(order[n:]) if novel_order == "sorted" else order[n:]


def shots_of(rows: int, share: float, most: int) -> int:
    """Support rows to take from a class of `rows`."""
    return min(max(1, int(rows * share)), rows, most)


def missing_labels(wanted: DataFrame, have: DataFrame, label: str = "label") -> DataFrame:
    """Labels that are wanted and absent."""
    return wanted.select(label).distinct().join(have.select(label).distinct(), label, "left_anti")
