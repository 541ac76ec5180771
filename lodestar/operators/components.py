"""Connected components by alternating large-star and small-star rounds.

First every task contracts the links it holds: a union-find over at most LOCAL
of them at a time leaves one link from each node to its smallest. That keeps
what is connected connected and takes most rounds off small graphs.

Every round is two aggregations with map-side combine and two joins, whose
plain exchanges adaptive execution can split where one node has many links. A
round is written to the shared checkpoint folder, so lineage stays short and a
lost executor costs no more than the round it was in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.session import cut

#: Rounds after which the operator gives up; the number needed grows as the
#: logarithm of the longest path.
MAX_ROUNDS = 60
#: Links that a task contracts at a time.
LOCAL = 500_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Links u > v with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def emit(schema: pa.Schema) -> pa.RecordBatch:
            made = [(x, find(x)) for x in list(root)]
            made = [(x, r) for x, r in made if x != r]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], schema.field(i).type) for i in (0, 1)], names=["u", "v"])

        held, schema = 0, None
        for batch in batches:
            schema = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
            held += batch.num_rows
            if held >= LOCAL:
                yield emit(schema)
                held = 0
        if held:
            yield emit(schema)

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _least(pairs: DataFrame) -> DataFrame:
    """node, least: of each node, the smallest of itself and its links."""
    return cut(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least")).select(F.col("u").alias("node"), "least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    return both.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select(F.col("node").alias("u"), F.col("least").alias("v"))).where("u > v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its smallest node) for every node that has a link.

    Links count both ways; a link of a node to itself makes it a component, a
    link with a null end is ignored, and repeated links change nothing.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    given = cut(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, was = cut(_contracted(given.where("u > v"))), None
    for _ in range(MAX_ROUNDS):
        state = _state(now)
        if state == was or not state[0]:
            break
        was, now = state, cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).unionByName(given.where("u = v").select(F.col("u").alias("node"))).distinct()
    alone = roots.join(now.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(alone.select("node", F.col("node").alias("component")))
