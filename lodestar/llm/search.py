"""Ranked lexical search over a two-level quantised index.

`build` writes the index: a row for each segment of documents, with its sorted
terms, their postings, and for each posting its frequency (second level) and
its impact in one byte, rounded up (first level). Segments are made where the
documents are read, so postings are never shuffled.

`search` takes all items against all segments, in blocks. A first pass reads
bytes only: weighted sums of them bound every document's score from above, and
one step less for each term bounds it from below. The k-th largest lower bound
over all segments is known after a merge of k numbers for each task and item; a
second pass scores exactly, in integers, every document whose upper bound
reaches it, whether there are k or many. No document that could be among the k
is left out, so results are those of scoring all.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a posting's impact is
10**9 tf div (1000 tf + 12 m), with m = 75 + 25 n N div L; N counts documents with
terms, L their terms, n one document's.

Defined cases: a null text has no terms and, like every document without terms,
counts nowhere; an item without terms has no rows; rows that repeat an id are
documents of their own; equal scores come by id, a null id last; repeated items
are ranked each; an empty table gives an empty result; other columns may have
any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import fresh_path, read_table

#: Bytes whose maximal runs are terms, lower-cased; all others part them.
WORDS = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
#: Documents and postings after which a segment is closed; bytes read at once.
DOCUMENTS, POSTINGS, SLICE = 4096, 1 << 19, 1 << 20
#: The largest impact is under a million; a byte counts steps of it, rounded up.
STEP = -(-1_000_000 // 255)
#: Characters of item texts in one block of items.
ITEM_CHARS = 1 << 22
#: Cells of scores that a task holds at once.
CELLS = 1 << 21

INDEX = "ids array<long>, lengths array<long>, terms array<string>, starts array<int>, docs array<int>, tfs array<int>, impacts binary"


def counted(text: bytes) -> Counter:
    """Terms of a text with their frequencies, a slice at a time."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + SLICE
        part = text[at:end].translate(WORDS)
        while end < len(text) and not part.endswith(b" "):  # on to the end of the term
            more = text[end : end + SLICE].translate(WORDS)
            stop = more.find(b" ") + 1 or len(more)
            part, end = part + more[:stop], end + stop
        found.update(part.split())
        at = end
    return found


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 10**9 * tf // (1000 * tf + 12 * (75 + 25 * n * documents // total))


def terms_in(text: memoryview) -> int:
    """How many terms a text has: bytes of terms that follow none."""
    n, before = 0, False
    for at in range(0, len(text), SLICE):
        inside = np.frombuffer(bytes(text[at : at + SLICE]).translate(WORDS), np.uint8) != 32
        n += int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[0] and not before)
        before = bool(inside[-1])
    return n


def statistics(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N and L."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_in(memoryview(t.as_buffer())) for t in batch.column(0).drop_null()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in found)], pa.int64()), pa.array([sum(found)], pa.int64())], names=["docs", "terms"])

    counted = df.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "docs long, terms long")
    row = counted.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row["docs"] or 0, row["terms"] or 0


def _segment(ids: list, lengths: list[int], terms: list[bytes], tfs: list[int], sizes: list[int], documents: int, total: int) -> pa.RecordBatch:
    """One row: postings in order of term and document."""
    coded = pa.array(terms, pa.binary()).dictionary_encode()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    term = place[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(ids)), sizes)
    by_term = np.argsort(term, kind="stable")
    tf, of = np.array(tfs, np.int64)[by_term], doc[by_term]
    level = -(-impacts(tf, np.array(lengths, np.int64)[of], documents, total) // STEP) if len(tf) else np.zeros(0)
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
    row = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
    columns = [row(ids, pa.int64()), row(lengths, pa.int64()), row(names.take(pa.array(order)).cast(pa.string()), None)]
    columns += [row(x.astype(np.int32), pa.int32()) for x in (starts, of, tf)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([level.astype(np.uint8).tobytes()], pa.binary())], names=[c.split(" ")[0] for c in INDEX.split(", ")])


def build(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the index of all documents and all their terms; returns the folder."""
    documents, total = statistics(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, terms, tfs, sizes = [], [], [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_buffer()
                found = counted(text.to_pybytes()) if text is not None else Counter()
                if not found:
                    continue
                ids.append(batch.column(0)[i].as_py())
                lengths.append(found.total())
                sizes.append(len(found))
                terms += found.keys()
                tfs += found.values()
                if len(ids) >= DOCUMENTS or len(terms) >= POSTINGS:
                    yield _segment(ids, lengths, terms, tfs, sizes, documents, total)
                    ids, lengths, terms, tfs, sizes = [], [], [], [], []
        if ids:
            yield _segment(ids, lengths, terms, tfs, sizes, documents, total)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    index = rows.mapInArrow(run, INDEX).withColumns({"documents": F.lit(documents).cast("long"), "total": F.lit(total).cast("long")})
    # A row group for each segment: neither the writer nor a reader of columns holds several.
    index.write.option("parquet.block.row.count.limit", 1).parquet(folder)
    return folder


def _places(terms: pa.ListScalar, wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted terms a segment has, and where."""
    own = terms.values.cast(pa.binary())
    at = pc.index_in(pa.array(wanted, pa.binary()), value_set=own)
    has = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return has, at.take(pa.array(has)).to_numpy(zero_copy_only=False).astype(np.int64)


class Items:
    """A block of items: their terms, and of each term the items that hold it
    and its weight times how often they do."""

    def __init__(self, texts: list[str | None]):
        self.size = len(texts)
        held: dict[bytes, list[tuple[int, int]]] = {}
        for q, text in enumerate(texts):
            for term, times in counted((text or "").encode()).items():
                held.setdefault(term, []).append((q, times))
        self.terms = sorted(held)
        self.items = [np.array([q for q, _ in held[t]], np.int64) for t in self.terms]
        self.weights = [np.array([times for _, times in held[t]], np.int64) for t in self.terms]

    def weigh(self, df: dict[int, int], documents: int) -> None:
        for i in range(len(self.terms)):
            w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[i] + 1))) if i in df else 0
            self.weights[i] = self.weights[i] * w

    def sums(self, starts: np.ndarray, docs: np.ndarray, values: list[np.ndarray], at: tuple[np.ndarray, np.ndarray], low: int, high: int, wide: int) -> list[np.ndarray]:
        """For items low to high, weighted sums by item and document of each of
        `values` (by posting)."""
        out = [np.zeros((high - low, wide), np.int64) for _ in values]
        for i, place in zip(*(x.tolist() for x in at), strict=True):
            some = slice(*np.searchsorted(self.items[i], [low, high]).tolist())
            rows, weight = self.items[i][some] - low, self.weights[i][some]
            s, e = starts[place], starts[place + 1]
            if not len(rows) or s == e or not weight.any():
                continue
            for x, v in zip(out, values, strict=True):
                if e - s == wide:  # every document holds the term
                    x[rows] += weight[:, None] * v[None, s:e]
                else:
                    x[rows[:, None], docs[None, s:e]] += weight[:, None] * v[None, s:e]
        return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}


def _array(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)


def _bounds(items: Items, segment: dict, width: int):
    """Blocks of items with their upper and lower bounds in steps."""
    at = _places(segment["terms"], items.terms)
    starts, docs = _array(segment["starts"]), _array(segment["docs"])
    level = np.frombuffer(segment["impacts"].as_buffer(), np.uint8).astype(np.int64)
    step = max(1, CELLS // max(1, width))
    for low in range(0, items.size, step):
        high = min(items.size, low + step)
        yield low, high, at, *items.sums(starts, docs, [level, np.maximum(level - 1, 0)], at, low, high, width)


def _frequencies(index: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each of the items' terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(items.terms), np.int64)
        for segment in _segments(batches):
            has, place = _places(segment["terms"], items.terms)
            starts = _array(segment["starts"])
            found[has] += starts[place + 1] - starts[place]
        has = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(found[has])], names=["term", "df"])

    sums = index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in sums.collect()}  # a number for each term of the block


def _search_block(index: DataFrame, rows: list[tuple], k: int, documents: int, total: int) -> DataFrame:
    """The k best of each item of a block: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    item_ids = [i for i, _ in rows]
    items = Items([t for _, t in rows])
    items.weigh(_frequencies(index, items), documents)

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((items.size, k), np.int64)
        for segment in _segments(batches):
            for low, high, _, _, bound in _bounds(items, segment, len(segment["ids"].values)):
                best[low:high] = -np.partition(-np.concatenate([best[low:high], bound], 1), k - 1, axis=1)[:, :k]
        item, _ = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[best > 0])], names=["item", "bound"])

    found = index.select("ids", "terms", "starts", "docs", "impacts").mapInArrow(lower, "item long, bound long")
    ordered = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"))))
    kth = np.zeros(items.size, np.int64)
    for r in ordered.where(F.col("rank") == k).select("item", "bound").collect():  # a number for each item of the block
        kth[r["item"]] = r["bound"]

    def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(items.size)]
        for segment in _segments(batches):
            ids, lengths, starts, docs, tfs = (_array(segment[c]) for c in ("ids", "lengths", "starts", "docs", "tfs"))
            known = segment["ids"].values.is_valid().to_numpy(zero_copy_only=False)
            for low, high, at, upper, _ in _bounds(items, segment, len(lengths)):
                open_ = (upper >= kth[low:high, None]) & (upper > 0)
                wanted = np.flatnonzero(open_.any(0))
                if not len(wanted):
                    continue
                # Only postings of documents that some item still wants.
                new = np.full(len(lengths), -1)
                new[wanted] = np.arange(len(wanted))
                some = new[docs] >= 0
                where = np.concatenate([[0], np.cumsum(some)])
                exact = impacts(tfs[some].astype(np.int64), lengths[docs[some]], documents, total)
                (score,) = items.sums(where[starts], new[docs[some]], [exact], at, low, high, len(wanted))
                score[~open_[:, wanted]] = 0
                if score.shape[1] > k:  # equal ones at the k-th place stay
                    score[score < -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]] = 0
                for q in np.flatnonzero(score.any(1)).tolist():
                    own = wanted[np.flatnonzero(score[q])]
                    more = zip((-score[q][score[q] > 0]).tolist(), (~known[own]).tolist(), np.where(known[own], ids[own], 0).astype(np.int64).tolist(), strict=True)
                    best[low + q] = sorted([*best[low + q], *more])[:k]
        out = [(q, None if null else d, -s) for q, own in enumerate(best) for s, null, d in own]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    scored = index.select("ids", "lengths", "terms", "starts", "docs", "tfs", "impacts").mapInArrow(rescored, "item long, doc_id long, score long")
    top = scored.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(item_ids)), "item long, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of every item the k best documents with a
    score above 0. Items are taken in blocks of bounded text."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    head = index.select("documents", "total").first()
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    empty = index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if head is None or not chars:
        return empty
    blocks = -(-chars // ITEM_CHARS)
    out = []
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        found = [(r["item_id"], r["text"]) for r in own.collect()]  # about ITEM_CHARS characters
        if found:
            out.append(_search_block(index, found, k, head["documents"], head["total"]))
    result = out[0] if out else empty
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def ranked(spark, sf_dir: str, k: int = 20) -> DataFrame:
    """All benchmark items against an index of all documents."""
    folder = build(read_table(spark, sf_dir, "documents"), fresh_path(spark, "index"))
    return search(spark.read.parquet(folder), read_table(spark, sf_dir, "benchmark"), k)
