"""Vector expressions over array<double> columns, all on the JVM side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def long_form(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """One row per element: the kept columns, j (from 0) and x."""
    return df.select(*keep, F.posexplode(vector).alias("j", "x")).withColumn("x", F.col("x").cast("double"))


def gathered(df: DataFrame, keys: list[str], j: str, x: str, out: str) -> DataFrame:
    """Back from long form; a vector's length bounds each group."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(j), F.col(x))))
    return df.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.transform("_p", lambda p: p[x]).alias(out))


#: Numbers of partial sums that a task holds before it hands them on.
HELD = 1 << 23


def vector_sums(df: DataFrame, keys: list[str], vector: str, weight: str | None = None, second: bool = False) -> DataFrame:
    """keys, n (sum of weights), rows, s1 (weighted sum) and, with `second`, s2
    (weighted sum of outer products, row by row) of each group.

    Tasks add their own rows in Arrow batches and hand on one partial for each
    group; partials meet by key in order and are added as they pass."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*keys, w.alias("_w"), F.col(vector).cast("array<double>").alias("_x")).where(F.col("_x").isNotNull())
    kinds = [pa_type(rows.schema[k].dataType) for k in keys]
    names = [*keys, "n", "rows", "s1", "s2"]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([f[0][i] for f in found], t) for i, t in enumerate(kinds)]
        lists = [pa.array([f[j].ravel() for f in found], pa.list_(pa.float64())) for j in (3, 4)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([float(f[1]) for f in found], pa.float64()), pa.array([int(f[2]) for f in found], pa.int64()), *lists], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = len(keys)
            of = list(zip(*(c.to_pylist() for c in batch.columns[:k]), strict=True)) if k else [()] * batch.num_rows
            place: dict[tuple, int] = {}
            at = np.array([place.setdefault(t, len(place)) for t in of])
            order = np.argsort(at, kind="stable")
            weights, x = batch.column(k).to_numpy(zero_copy_only=False)[order], matrix(batch.column(k + 1))[order]
            ends = np.append(np.searchsorted(at[order], np.arange(len(place))), len(of))
            weighted = x * weights[:, None]
            for key, i in place.items():
                s, e = ends[i], ends[i + 1]
                part = [weights[s:e].sum(), e - s, weighted[s:e].sum(0), weighted[s:e].T @ x[s:e] if second else np.zeros(0)]
                if key in held:
                    held[key] = [a + b for a, b in zip(held[key], part, strict=True)]
                else:
                    held[key] = part
                    size += part[2].size + part[3].size
            if size > HELD:
                yield batch_of([(key, *v) for key, v in held.items()])
                held, size = {}, 0
        yield batch_of([(key, *v) for key, v in held.items()])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0
        for batch in batches:
            of = list(zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True)) if keys else [()] * batch.num_rows
            n, count = (batch.column(len(keys) + j).to_pylist() for j in (0, 1))
            for i, key in enumerate(of):
                part = (n[i], count[i], *(batch.column(len(keys) + j)[i].values.to_numpy() for j in (2, 3)))
                if now is not None and now[0] == key:
                    now = (key, *(a + b for a, b in zip(now[1:], part, strict=True)))
                    continue
                if now is not None:
                    out.append(now)
                    size += now[3].size + now[4].size
                    if size > HELD // 8:
                        yield batch_of(out)
                        out, size = [], 0
                now = (key, *part)
        yield batch_of([*out, *([now] if now is not None else [])])

    kind = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "n double, `rows` long, s1 array<double>, s2 array<double>"])
    partial = rows.mapInArrow(summed, kind)
    met = partial.repartition(*keys).sortWithinPartitions(*keys) if keys else partial.coalesce(1)  # without keys, one row for each task
    return met.mapInArrow(added, kind).select(*keys, "n", "rows", "s1", *["s2"] * second)


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, weight: str | None = None, out: str = "center") -> DataFrame:
    """Weighted mean vector of each group. Groups whose weights sum to zero or
    less are an error."""
    wrong = F.raise_error(F.lit("weights sum to zero or less")).cast("double")
    n = F.when(F.col("n") > 0, F.col("n")).otherwise(wrong)
    return vector_sums(df, keys, vector, weight).select(*keys, F.transform("s1", lambda x: x / n).alias(out))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of an Arrow batch as a float64 matrix, without a loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))
