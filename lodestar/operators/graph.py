"""Within-class nearest-neighbour graphs, mutual edges and localisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.session import cut, scope
from lodestar.functions.vectors import norm
from lodestar.operators import metric as index
from lodestar.operators.components import connected_components


def nearest(df: DataFrame, r: int, key: str = "row_id", label: str = "label", vector: str = "x", metric: str = "euclidean", chunk: int = index.CHUNK) -> DataFrame:
    """src, dst, label, d2, rank: the r nearest others of each row within its
    class, ties by dst; d2 is the squared distance (or 1 - cosine). A null label
    is a class of its own, a row without a vector has no neighbours, and a row is
    never its own neighbour, under whichever rows repeat its key."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    v = F.col(vector).cast("array<double>")
    if metric == "cosine":
        v = F.transform(v, lambda x: x / F.greatest(norm(F.col(vector).cast("array<double>")), F.lit(1e-12)))
    of = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    rows = cut(index.marked(df.select(of.alias("of"), F.lit(None).cast("string").alias("label"), F.col(key).cast("long").alias("id"), v.alias("v"))))
    found = index.within(index.build(rows, r + 1, chunk), r + 1)
    others = F.slice(F.filter("found", lambda x: x["ref"] != F.col("id")), 1, r)
    edges = rows.select("id", "of", "a", "b").join(found, ["a", "b"]).select("id", "of", F.posexplode(others).alias("at", "near"))
    d2 = F.col("near.d2") / (2 if metric == "cosine" else 1)
    named = F.when(F.col("of") != "", F.substring("of", 2, 1 << 30))
    return edges.select(F.col("id").alias("src"), F.col("near.ref").alias("dst"), named.alias("label"), d2.alias("d2"), (F.col("at") + 1).cast("int").alias("rank"))


def mutual(edges: DataFrame) -> DataFrame:
    """Directed edges whose reverse is an edge too."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi")


def components(nodes: DataFrame, edges: DataFrame, key: str = "row_id") -> DataFrame:
    """row and component (smallest row reachable); rows without edges alone."""
    found = connected_components(edges)
    return nodes.select(key).join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("component"))


def localise(df: DataFrame, r: int, least: int, key: str = "row_id", label: str = "label", vector: str = "x", namespace: str = "unit") -> DataFrame:
    """row, label, component, size, unit_id: components of mutual edges of at
    least `least` rows are units, numbered within their class by smallest row;
    smaller ones are residual (null unit)."""
    with scope(df.sparkSession) as own:  # the index and its vectors go once the edges are known
        edges = cut(nearest(df, r, key, label, vector))
        own.keep(edges)
    placed = components(df, mutual(edges), key).join(df.select(key, F.col(label).cast("string").alias("of")), key)
    sizes = cut(placed.groupBy("component", "of").agg(F.count(F.lit(1)).alias("size")))
    numbered = sizes.where(F.col("size") >= least).withColumn("i", F.row_number().over(Window.partitionBy("of").orderBy("component")) - 1)
    named = numbered.select("component", F.concat_ws(":", F.lit(namespace), "of", F.col("i").cast("string")).alias("unit_id"))
    return placed.join(sizes.drop("of"), "component").join(named, "component", "left").select(key, F.col("of").alias("label"), "component", "size", "unit_id")


def nearest_unit(residuals: DataFrame, units: DataFrame, key: str = "row_id") -> DataFrame:
    """For residual rows (row, label, x) the closest unit centre (unit_id, label,
    center) of their class; null where the class has none."""
    from lodestar.functions.vectors import squared_distance

    paired = residuals.join(units.select("unit_id", "label", "center"), "label", "left")
    d = squared_distance(F.col("x"), F.col("center"))
    return paired.groupBy(key, "label").agg(F.min(F.when(F.col("unit_id").isNotNull(), F.struct(d.alias("d2"), "unit_id"))).alias("m")).select(key, "label", "m.unit_id")
