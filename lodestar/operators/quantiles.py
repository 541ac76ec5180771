"""Exact quantiles without gathering a column in one task.

Distinct values are counted with map-side combine, range-partitioned by column
and value, and only the partitions that hold a wanted rank are ordered. The
driver sees one count for each partition and the few values asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.session import cut


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column's values that are neither
    null nor NaN; None for a column without any."""
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)))).alias("x")).select("x.*")
    counted = pairs.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(counted.repartitionByRange("c", "v").withColumn("p", F.spark_partition_id()))
    parts: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("c", "p").agg(F.sum("n").alias("n")).collect():  # one row for each partition and column
        parts.setdefault(r["c"], []).append((r["p"], r["n"]))
    wanted, sizes = [], {}
    for c, found in parts.items():
        sizes[c] = sum(n for _, n in found)
        ranks = sorted({k for q in qs for k in (math.floor(q * (sizes[c] - 1)), math.ceil(q * (sizes[c] - 1)))})
        before = 0
        for p, n in sorted(found):
            wanted += [(c, p, k - before, k) for k in ranks if before <= k < before + n]
            before += n
    values: dict[tuple[int, int], float] = {}
    if wanted:
        asked = F.broadcast(df.sparkSession.createDataFrame(wanted, "c int, p int, inside long, rank long"))  # two rows for each quantile and column
        some = placed.join(asked.select("c", "p").distinct(), ["c", "p"], "left_semi")
        run = some.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
        hits = run.join(asked, ["c", "p"]).where((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
        values = {(r["c"], r["rank"]): r["v"] for r in hits.select("c", "rank", "v").collect()}

    def at(c: int, q: float) -> float | None:
        if c not in sizes:
            return None
        place = q * (sizes[c] - 1)
        low, high = values[c, math.floor(place)], values[c, math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    return {name: [at(c, q) for q in qs] for c, name in enumerate(columns)}
