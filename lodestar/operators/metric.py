"""Exact nearest neighbours by a metric index.

Equal vectors of a group are one point, which keeps its smallest row ids. Some
points, the first in order of a hash, are pivots; each point belongs to the
cell of its nearest pivot, a ball with known inner and outer radius. Pivots
and radii are the upper level of the index: their bytes are bounded
(PIVOT_BYTES; more points make cells larger, not pivots more) and they are
broadcast. Cells are the leaves, dealt by ball; one of over `chunk` points is
split into several balls.

A query first meets the points of its own ball, which bounds the distance it
has to look at. Radii, and the planes between pivots, then prove other balls
further away; it is forwarded to the rest only, and what it finds there is
merged. So results are those of comparing all pairs, whatever the cells are.
Balls lie on shelves of bounded bytes. A query travels once to each shelf that has
a ball its bound does not exclude, with a bit for each such ball, and a shelf
meets its queries in slices of as many bytes. So where bounds exclude little, as in
many dimensions, what travels grows with the shelves and not with the balls.

Equal distances are settled by row id. Groups are never compared with each
other; a group of up to `chunk` points is one ball and needs no second pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.session import cut
from lodestar.functions.vectors import matrix

#: Points of a ball, and queries that meet it in one task; bytes of all pivots, and
#: of the vectors of a shelf or of the queries that meet it in one task.
CHUNK, SLICE, PIVOT_BYTES, SHELF_BYTES = 1024, 8192, 64 << 20, 32 << 20
#: Room for rounding: of a distance, and, relative to the largest vector, of squared
#: distances by products and of their roots.
ROOM, FINE, COARSE = 1e-9, 1e-11, 1e-6

FOUND = "array<struct<d2:double,ref:long,label:string>>"


@dataclass
class Cells:
    """The upper level for one group: radii of each cell, its first ball and how
    many balls it has; pivots if there are several cells."""

    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    balls: np.ndarray
    pivots: np.ndarray | None = None

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell and the distances to all pivots."""
        if self.pivots is None:
            return np.zeros(len(v), np.int64), np.zeros((len(v), 1))
        d = np.empty((len(v), len(self.pivots)))
        square = (self.pivots**2).sum(1)
        for at in range(0, len(v), 1024):
            part = v[at : at + 1024]
            rough = (part * part).sum(1)[:, None] + square - 2 * part @ self.pivots.T
            d[at : at + 1024] = np.sqrt(np.maximum(rough, 0))
        return d.argmin(1), d

    def reach(self, d: np.ndarray, cell: np.ndarray, far: np.ndarray, scale: float) -> np.ndarray:
        """Which cells may hold a point within `far` of each query, by the rings
        that hold the cells and by the planes half-way between pivots."""
        near, at = np.unique(cell, return_inverse=True)
        between = np.stack([np.sqrt(((self.pivots - self.pivots[c]) ** 2).sum(1)) for c in near])[at]
        own = d[np.arange(len(d)), cell][:, None]
        bound = np.maximum(d - self.high, self.low - d)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (d * d - own * own - FINE * scale * scale) / (2 * between), -np.inf)
        return np.maximum(bound, plane) <= (far + ROOM * np.where(np.isfinite(far), far, 0) + COARSE * scale)[:, None]


@dataclass
class Index:
    """Points of all groups in their balls (ball, of, label, a, b, ids, v), and
    the cells of each group. `ids` has up to `depth` ids of each point."""

    members: DataFrame
    cells: dict[str, Cells]
    depth: int

    def save(self, folder: str) -> None:
        """Two tables: the members, and a row for each cell."""
        spark = self.members.sparkSession
        rows = [(of, i, c.low[i].item(), c.high[i].item(), int(c.first[i]), int(c.balls[i]), None if c.pivots is None else c.pivots[i].tolist(), self.depth) for of, c in self.cells.items() for i in range(len(c.low))]
        kind = "of string, cell int, low double, high double, first int, balls int, pivot array<double>, depth int"
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/cells")
        self.members.write.parquet(f"{folder}/members")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        rows: dict[str, list] = {}
        depth = 0
        for r in spark.read.parquet(f"{folder}/cells").orderBy("of", "cell").collect():  # within PIVOT_BYTES
            rows.setdefault(r["of"], []).append(r)
            depth = r["depth"]
        column = lambda own, name, kind: np.array([r[name] for r in own], kind)
        cells = {of: Cells(column(own, "low", float), column(own, "high", float), column(own, "first", int), column(own, "balls", int), None if own[0]["pivot"] is None else column(own, "pivot", float)) for of, own in rows.items()}
        return Index(spark.read.parquet(f"{folder}/members"), cells, depth)


def marked(df: DataFrame) -> DataFrame:
    """of, label, id, v and a, b: 128 bits that name the point of a row."""
    mark = lambda seed: F.xxhash64(F.lit(seed), F.col("of"), F.coalesce("label", F.lit("")), F.col("label").isNull(), F.col("v"))
    return df.where(F.col("v").isNotNull()).select("of", "label", "id", "v", mark(1).alias("a"), mark(2).alias("b"))


def points(rows: DataFrame, depth: int) -> DataFrame:
    """of, label, a, b, v, ids: equal vectors of a group and label as one, with
    the `depth` smallest ids. Ranks are limited before rows are shuffled."""
    keys = ["of", "label", "a", "b"]
    least = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_r") <= depth)
    return least.groupBy(*keys).agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def build(rows: DataFrame, depth: int, chunk: int = CHUNK) -> Index:
    """The index of rows as `marked` gives them, materialised."""
    spark = rows.sparkSession
    groups = rows.groupBy("of").agg(F.approx_count_distinct("a", 0.02).alias("n"), F.max(F.size("v")).alias("width")).collect()  # a row for each group
    counts = {r["of"]: r["n"] for r in groups}
    width = max((r["width"] for r in groups), default=1)
    chunk = max(chunk, -(-sum(counts.values()) * width * 8 // PIVOT_BYTES))
    several = {of: -(-n // chunk) for of, n in counts.items() if n > chunk}
    pivots: dict[str, np.ndarray] = {}
    if several:
        # About twice the pivots by a hash of the vector; copies of one are one before they meet.
        shares = F.broadcast(spark.createDataFrame([(of, 2.0 * n / counts[of]) for of, n in several.items()], "of string, share double"))
        some = rows.select("of", "a", "b", "v").join(shares, "of").where(F.pmod("a", F.lit(1 << 31)) < F.col("share") * (1 << 31))
        found: dict[str, list] = {}
        for r in some.groupBy("of", "a", "b").agg(F.first("v").alias("v")).orderBy("of", "a", "b").select("of", "v").collect():  # about twice PIVOT_BYTES
            if len(own := found.setdefault(r["of"], [])) < several[r["of"]]:
                own.append(r["v"])
        pivots = {of: np.array(v, float) for of, v in found.items()}
    empty = np.zeros(0)
    upper = spark.sparkContext.broadcast({of: Cells(empty, empty, empty, empty, p) for of, p in pivots.items()})

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, v = np.array(batch.column(0).to_pylist(), object), matrix(batch.column(4))
            cell, far = np.zeros(len(of), np.int32), np.zeros(len(of))
            for c in set(of) & set(upper.value):
                own = np.flatnonzero(of == c)
                cell[own], d = upper.value[c].place(v[own])
                far[own] = np.sqrt(((v[own] - upper.value[c].pivots[cell[own]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    pts = points(rows, depth).select("of", "label", "a", "b", "v", "ids")
    kind = "of string, label string, a long, b long, v array<double>, ids array<long>, cell int, far double"
    placed = cut(pts.mapInArrow(assigned, kind) if several else pts.withColumns({"cell": F.lit(0), "far": F.lit(0.0)}))
    sizes = placed.groupBy("of", "cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).collect()  # a row for each cell
    by_group: dict[str, list] = {}
    for r in sorted(sizes, key=lambda r: (r["of"], r["cell"])):
        by_group.setdefault(r["of"], []).append(r)
    cells, table, first = {}, [], 0
    for of, own in by_group.items():
        n = len(pivots[of]) if of in pivots else 1
        c = Cells(np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, int), np.zeros(n, int), pivots.get(of))
        for r in own:
            i = r["cell"]
            c.low[i], c.high[i], c.first[i], c.balls[i] = r["low"], r["high"], first, -(-r["n"] // (4 * chunk))
            table.append((of, i, first, int(c.balls[i])))
            first += int(c.balls[i])
        cells[of] = c
    names = F.broadcast(spark.createDataFrame(table, "of string, cell int, _first int, _balls int"))  # a row for each cell
    ball = (F.col("_first") + F.pmod(F.col("a"), F.col("_balls"))).cast("int")
    members = placed.join(names, ["of", "cell"]).select(ball.alias("ball"), "of", "label", "a", "b", "ids", "v")
    return Index(members, cells, depth)


def _best(v: np.ndarray, own: np.ndarray, ids: list, k: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """query, d2, ref and member of the k nearest ids of each query row of v
    among the members `own`, none further than `most`; ties by id."""
    center = own.mean(0)
    x, y = v - center, own - center
    sx, sy = (x * x).sum(1), (y * y).sum(1)
    near = min(k, len(own))
    sizes = np.array([len(i) for i in ids])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate([np.asarray(i, np.int64) for i in ids])
    out: tuple[list, list, list, list] = ([], [], [], [])
    step = max(1, (1 << 22) // max(len(own), 1))
    for at in range(0, len(x), step):
        some = slice(at, at + step)
        rough = sx[some, None] + sy - 2 * x[some] @ y.T
        # The k-th rough distance plus what rounding can do to it.
        slack = 1e-14 * (v.shape[1] + 8) * (sx[some, None] + sy.max() + 1e-300)
        limit = most[some, None] + slack + ROOM * np.where(np.isfinite(most[some, None]), most[some, None], 0)
        within = rough <= limit
        if np.count_nonzero(within) > 8 * near * len(within):  # bounds that exclude little
            within = rough <= np.minimum(np.partition(rough, near - 1, axis=1)[:, near - 1 : near] + 2 * slack, limit)
        i, j = np.nonzero(within)
        exact = np.concatenate([((v[some][i[s : s + 65536]] - own[j[s : s + 65536]]) ** 2).sum(1) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        many = sizes[j]
        place = np.repeat(starts[j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        q, d2, member, ref = np.repeat(i, many), np.repeat(exact, many), np.repeat(j, many), flat[place]
        order = np.lexsort((ref, d2, q))
        q, d2, member, ref = q[order], d2[order], member[order], ref[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        for column, values in zip(out, (q + at, d2, ref, member), strict=True):
            column.append(values[keep])
    return tuple(np.concatenate(c) if c else np.zeros(0, int) for c in out)


def _lists(q: np.ndarray, rows: int, values: list[pa.Array], names: list[str] | None) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(q, minlength=rows))])
    inner = pa.StructArray.from_arrays(values, names) if names else values[0]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)


def _meeting(k: int, upper, first: bool, own: bool, shelves=None) -> Callable[[pa.Table], pa.Table]:
    """On the first visit one ball: what its queries find in it, and which other
    balls they have to see, by shelf (without shelves, each ball is one). Later
    one shelf. With `own` the members are the queries."""
    if not first:
        return _visiting(k, shelves)

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("ids").to_pylist()
        is_member = np.array([i is not None for i in ids], bool)
        v = matrix(group.column("v"))
        queries = np.flatnonzero(is_member if own else ~is_member)
        members = np.flatnonzero(is_member)
        of = group.column("of")[0].as_py()
        asked, there = v[queries], v[members]
        if len(members) and len(queries):
            q, d2, ref, at = _best(asked, there, [ids[i] for i in members], k, np.full(len(queries), np.inf))
        else:
            q, d2, ref, at = (np.zeros(0, int) for _ in range(4))
        reached = np.full(len(queries), np.inf)  # the squared distance of the k-th id, if there are so many
        last = np.flatnonzero(np.bincount(q.astype(int), minlength=len(queries)) == k)
        reached[last] = d2[np.searchsorted(q, last, "right") - 1]
        cells = upper.value.get(of)
        visits = [(np.zeros(0, int), 0, [])]  # queries, shelf, bits of its balls
        if cells is not None and cells.balls.sum() > 1:
            scale = float(np.abs(v).max(initial=0)) * v.shape[1] ** 0.5
            cell, d = cells.place(asked)
            open_ = np.ones((len(queries), 1), bool) if cells.pivots is None else cells.reach(d, cell, np.sqrt(reached), scale)
            low, high = int(cells.first[cells.balls > 0].min()), int((cells.first + cells.balls).max())
            balls = np.repeat(open_, cells.balls, axis=1)  # a group's balls are numbered by cell
            balls[:, group.column("ball")[0].as_py() - low] = False
            held = shelves.value if shelves else Shelves(np.arange(high + 1), 0.0)
            for shelf in range(held.holding(low), held.holding(high - 1) + 1):
                start, end = held.first[shelf], held.first[shelf + 1]
                bits = np.zeros((len(queries), end - start), bool)
                s, e = max(low, start), min(high, end)
                bits[:, s - start : e - start] = balls[:, s - low : e - low]
                some = np.flatnonzero(bits.any(1))
                visits.append((some, shelf, [row.tobytes() for row in np.packbits(bits[some], axis=1)]))
        who = np.concatenate([x[0] for x in visits])
        where = np.repeat([x[1] for x in visits], [len(x[0]) for x in visits])
        order = np.argsort(who, kind="stable")
        seen = pa.array([m for x in visits for m in x[2]], pa.binary()).take(pa.array(order))
        take = pa.array(queries, pa.int64())
        columns = [group.column(c).take(take) for c in ("a", "b")] + [_found(group, members, len(queries), q, d2, ref, at), group.column("v").take(take), pa.array(reached)]
        columns.append(_lists(who[order], len(queries), [pa.array(where[order].astype(np.int32)), seen], ["shelf", "balls"]))
        return pa.table(columns, names=["a", "b", "found", "v", "far", "visits"])

    return run


def _found(group: pa.Table, members: np.ndarray, queries: int, q: np.ndarray, d2: np.ndarray, ref: np.ndarray, at: np.ndarray) -> pa.ListArray:
    labels = group.column("label").combine_chunks().take(pa.array(members[at.astype(int)], pa.int64()))
    return _lists(q.astype(int), queries, [pa.array(d2, pa.float64()), pa.array(ref, pa.int64()), labels], ["d2", "ref", "label"])


def _visiting(k: int, shelves) -> Callable[[pa.Table], pa.Table]:
    """One shelf and a slice of its queries: what they find in the balls that
    their bits name."""

    def run(group: pa.Table) -> pa.Table:
        ball = group.column("ball").to_numpy(zero_copy_only=False)
        members, queries = np.flatnonzero(~np.isnan(ball)), np.flatnonzero(np.isnan(ball))
        members = members[np.argsort(ball[members], kind="stable")]
        take = pa.array(queries, pa.int64())
        parts = [(np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, int))]
        if len(members) and len(queries):
            asked, there = matrix(group.column("v").take(take)), matrix(group.column("v").take(pa.array(members, pa.int64())))
            ids = group.column("ids").take(pa.array(members, pa.int64())).to_pylist()
            far = group.column("far").take(take).to_numpy(zero_copy_only=False).copy()
            bits = np.stack([np.unpackbits(np.frombuffer(m, np.uint8)) for m in group.column("balls").take(take).to_pylist()])
            first = shelves.value.first[group.column("shelf")[0].as_py()]
            names, starts = np.unique(ball[members].astype(int), return_index=True)
            for name, s, e in zip(names, starts, [*starts[1:], len(members)], strict=True):
                some = np.flatnonzero(bits[:, name - first])
                if not len(some):
                    continue
                q, d2, ref, at = _best(asked[some], there[s:e], ids[s:e], k, far[some])
                last = np.flatnonzero(np.bincount(q, minlength=len(some)) == k)
                far[some[last]] = np.minimum(far[some[last]], d2[np.searchsorted(q, last, "right") - 1])
                parts.append((some[q], d2, ref, at + s))
        q, d2, ref, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ref, d2, q))
        q = q[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        order = order[keep]
        found = _found(group, members, len(queries), q[keep], d2[order], ref[order], at[order])
        return pa.table([group.column("a").take(take), group.column("b").take(take), found], names=["a", "b", "found"])

    return run


FIRST = f"a long, b long, found {FOUND}, v array<double>, far double, visits array<struct<shelf:int,balls:binary>>"


@dataclass
class Shelves:
    """Runs of balls of bounded bytes: the first ball of each shelf, and at last
    the number of all; how many shelves' bytes a row takes."""

    first: np.ndarray
    share: float

    def holding(self, ball: int) -> int:
        return int(np.searchsorted(self.first, ball, "right")) - 1

    @staticmethod
    def of(index: Index) -> Shelves:
        total = int(max((int((c.first + c.balls).max(initial=0)) for c in index.cells.values()), default=0))
        if total <= 1:
            return Shelves(np.array([0, total]), 0.0)
        sizes, width = np.zeros(total), 1
        for r in index.members.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).collect():  # a row for each ball
            sizes[r["ball"]], width = r["n"], max(width, r["width"])
        share = width * 8 / SHELF_BYTES
        first, held = [0], 0.0
        for ball, n in enumerate(sizes):
            if held and held + n * share > 1:
                first.append(ball)
                held = 0.0
            held += n * share
        return Shelves(np.array([*first, total]), share)


def _met(index: Index, queries: DataFrame, k: int, upper, shelves) -> DataFrame:
    """Queries (ball, of, a, b, v) against the members of their balls; a ball
    with more than SLICE of them meets them in several tasks."""
    counts = queries.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).select("ball", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    counts = F.broadcast(cut(counts))  # a row for each ball
    asked = queries.join(counts, "ball").select("ball", F.pmod(F.xxhash64("a", "b"), "slices").cast("int").alias("slice"), "of", F.lit(None).cast("string").alias("label"), "a", "b", F.lit(None).cast("array<long>").alias("ids"), "v")
    there = index.members.join(counts, "ball").select("ball", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "of", "label", "a", "b", "ids", "v")
    return asked.unionByName(there).groupBy("ball", "slice").applyInArrow(_meeting(k, upper, True, False, shelves), FIRST)


def _forwarded(index: Index, met: DataFrame, k: int, upper, sent) -> DataFrame:
    """a, b, found: after the visits that bounds do not exclude, the k best ids."""
    if all(c.balls.sum() <= 1 for c in index.cells.values()):
        return met.select("a", "b", "found")
    spark, shelves = met.sparkSession, sent.value
    met = cut(met)
    further = met.select("a", "b", "v", "far", F.explode("visits").alias("to")).select("to.shelf", "to.balls", "a", "b", "v", "far")
    # Slices of a shelf's bytes, and with few shelves enough of them for all cores.
    least = -(-spark.sparkContext.defaultParallelism // (len(shelves.first) - 1))
    counts = further.groupBy("shelf").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("shelf", F.greatest(F.ceil(F.col("n") * shelves.share), F.least(F.lit(least), F.ceil(F.col("n") / CHUNK))).cast("int").alias("slices"))
    counts = F.broadcast(cut(counts))  # a row for each shelf
    none = lambda kind: F.lit(None).cast(kind)
    asked = further.join(counts, "shelf").select("shelf", F.pmod(F.xxhash64("a", "b"), "slices").cast("int").alias("slice"), none("int").alias("ball"), "balls", none("string").alias("label"), "a", "b", none("array<long>").alias("ids"), "v", "far")
    table = spark.createDataFrame([(b, s) for s in range(len(shelves.first) - 1) for b in range(int(shelves.first[s]), int(shelves.first[s + 1]))], "ball int, shelf int")
    members = index.members.join(F.broadcast(table), "ball").join(counts, "shelf")  # a row for each ball
    there = members.select("shelf", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "ball", none("binary").alias("balls"), "label", "a", "b", "ids", "v", none("double").alias("far"))
    again = asked.unionByName(there).groupBy("shelf", "slice").applyInArrow(_meeting(k, upper, False, False, sent), f"a long, b long, found {FOUND}")
    both = met.select("a", "b", "found").unionByName(again.where(F.size("found") > 0))
    return both.groupBy("a", "b").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def within(index: Index, k: int) -> DataFrame:
    """a, b, found: the k nearest ids of each point in its own group, its own
    ids among them."""
    spark = index.members.sparkSession
    upper, shelves = spark.sparkContext.broadcast(index.cells), spark.sparkContext.broadcast(Shelves.of(index))
    return _forwarded(index, index.members.groupBy("ball").applyInArrow(_meeting(k, upper, True, True, shelves), FIRST), k, upper, shelves)


def probe(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """a, found: the k nearest ids of queries (a long, of string, v) in their group."""
    if k > index.depth:
        raise ValueError(f"the index keeps {index.depth} ids of a point, {k} are asked for")
    spark = queries.sparkSession
    upper, shelves = spark.sparkContext.broadcast(index.cells), spark.sparkContext.broadcast(Shelves.of(index))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, of, v = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), matrix(batch.column(2))
            ball = np.full(len(of), -1, np.int32)
            for c in set(of) & set(upper.value):
                own, cells = np.flatnonzero(of == c), upper.value[c]
                cell, d = cells.place(v[own])
                if cells.pivots is not None:  # the nearest pivot whose cell has points
                    cell = np.where(cells.balls > 0, d, np.inf).argmin(1)
                ball[own] = cells.first[cell] + a[own] % np.maximum(cells.balls[cell], 1)
            yield pa.RecordBatch.from_arrays([pa.array(ball), *batch.columns], names=["ball", "a", "of", "v"])

    asked = queries.where(F.col("v").isNotNull()).select("a", "of", "v").mapInArrow(routed, "ball int, a long, of string, v array<double>").where(F.col("ball") >= 0)
    asked = cut(asked.select("ball", "of", "a", F.lit(0).cast("long").alias("b"), "v"))
    return _forwarded(index, _met(index, asked, k, upper, shelves), k, upper, shelves).select("a", "found")
