"""Running sums and maxima over a whole order, without one task that sees it all.

Rows are range-partitioned by group and order, each partition runs over its own
rows, and what came before it is carried from one row for each partition and
group. So neither a table without groups nor a group with most rows meets in a
single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.session import cut


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """All columns and, of each group in that order, running sums and maxima
    that include the row itself. Rows that are equal in the order run as they
    fall, so the order should tell rows apart."""
    kinds = {**{k: (v, F.sum) for k, v in (sums or {}).items()}, **{k: (v, F.max) for k, v in (maxima or {}).items()}}
    given = df.withColumns({f"_v_{k}": v for k, (v, _) in kinds.items()})
    grouped = [F.col(k) for k in keys]
    placed = cut(given.repartitionByRange(*grouped, *order).withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy("_p", *keys).agg(*(f(f"_v_{k}").alias(f"_t_{k}") for k, (_, f) in kinds.items()))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of a group
    carried = totals.select("_p", *keys, *(f(f"_t_{k}").over(before).alias(f"_c_{k}") for k, (_, f) in kinds.items()))
    renamed = carried.withColumnsRenamed({"_p": "_q", **{k: f"_k{i}" for i, k in enumerate(keys)}})
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    here = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({f"_r_{k}": f(f"_v_{k}").over(here) for k, (_, f) in kinds.items()}).join(renamed, same)
    joined = {k: (F.col(f"_r_{k}") + F.coalesce(F.col(f"_c_{k}"), F.lit(0))) if f is F.sum else F.greatest(f"_r_{k}", f"_c_{k}") for k, (_, f) in kinds.items()}
    return run.select(*df.columns, *(v.alias(k) for k, v in joined.items()))


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """All columns and the place (from 1) of each row in its group."""
    return running(df, keys, order, {out: F.lit(1).cast("long")})
