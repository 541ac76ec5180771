"""Quality classification by nearest-neighbour voting.

Terms of a document are runs of three character classes (letters by case,
digits, spaces, each common mark), how often words follow themselves, and
hashed runs of four bytes, which hold what the words are in any script. Their
damped frequencies, weighted by rarity, are reduced to `dims` latent dimensions
by a singular value decomposition of the labelled sample. The sample's vectors
(at most `sample` x `dims` numbers) are broadcast; every document's exact
cosines with all of them are matrix products, block by block, and the `k`
nearest vote, weighted by a power of their similarity.

Learning takes `sample` labels of training rows at most, chosen by the hash of
their id. Label, language, source and id are never inputs of a score.

Defined cases: an empty or null text has no terms and gets the share of label
1 in the sample; with nothing to learn from every score is 0.5; a row without
label teaches nothing, of several labels of an id each counts; of rows that
repeat an id the one with the smallest text hash teaches; neighbours as near as
the k-th (cosines to five decimals) all vote; texts of any length are read
whole, a slice at a time; repeated rows get equal scores; other columns may
have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import held_out

SAMPLE, DIMS, NEIGHBOURS, THRESHOLD = 3000, 48, 15, 0.3
#: Power of the similarity that weighs a neighbour's vote, so distant ones count little.
SHARPNESS = 4
BLOCK, SLICE = 256, 1 << 20
#: Rows of the sample that a term must occur in to count.
LEAST_ROWS = 3
#: Marks that are a class each; other ASCII marks share one.
MARKS = ".,!?%$&*#|\"'"
CLASSES = 8 + len(MARKS)
REPEATS = 8
#: Buckets of hashed runs of four bytes, and their weight beside the classes.
HASHED, CONTENT = 1 << 10, 0.5
SHAPES = CLASSES**3 + REPEATS
TERMS = SHAPES + HASHED


def _classes() -> np.ndarray:
    """Class of each byte: 0 lower-case letter (or beyond ASCII), 1 upper-case,
    2 digit, 3 blank, 4 line end, 5 other control, 6 other mark, 7 text edge."""
    table = np.zeros(256, np.int32)
    for b in range(128):
        c = chr(b)
        if c in MARKS:
            table[b] = 8 + MARKS.index(c)
        else:
            table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c in "\r\n" else 5 if b < 32 or b == 127 else 6
    return table


CLASS_OF = _classes()
#: Odd multipliers of the four bytes of a run, and lower-case bytes.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint32) + np.uint32(1)


def terms(data: bytes) -> np.ndarray:
    """Damped relative frequencies of a document's terms (length TERMS)."""
    shapes, content = np.zeros(CLASSES**3, np.float32), np.zeros(HASHED, np.float32)
    again = words = 0
    last = None
    at = 0
    while at < len(data):  # slices end after a blank where they can; each also sees the bytes before it
        stop = len(data) if len(data) - at <= SLICE else data.rfind(b" ", at, at + SLICE) + 1 or at + SLICE
        seen = np.frombuffer(data[max(0, at - 3) : stop], np.uint8)
        c = CLASS_OF[seen[max(0, min(at, 3) - 2) :]]
        if len(c) > 2:
            shapes += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        if len(seen) > 3:
            x = LOWER[seen]
            mixed = x[:-3] * FACTORS[0] + x[1:-2] * FACTORS[1] + x[2:-1] * FACTORS[2] + x[3:] * FACTORS[3]
            content += np.bincount((mixed ^ (mixed >> np.uint32(15))) * FACTORS[0] >> np.uint32(22), minlength=HASHED)
        found = data[at:stop].split()
        words += len(found)
        again += sum(map(bytes.__eq__, found, ([last] if last is not None else [b""]) + found[:-1])) if found else 0
        last = found[-1] if found else last
        at = stop
    repeats = np.zeros(REPEATS, np.float32)
    if words > 1:  # one of these says how often words follow themselves
        repeats[min(REPEATS - 1, int(REPEATS * again / words))] = 1.0
    return np.concatenate([np.sqrt(shapes / max(1, shapes.sum())), repeats, CONTENT * np.sqrt(content / max(1, content.sum()))])


class Latent:
    """Rarity weights and the projection, from the sample's terms: `used` says
    which terms the columns of `rows` are."""

    def __init__(self, rows: np.ndarray, used: np.ndarray, dims: int):
        self.used = used
        self.weight = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 0.1).astype(np.float32)
        x = rows * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        # The leading right singular vectors, from the smaller of both Gram matrices.
        if x.shape[1] <= x.shape[0]:
            _, v = np.linalg.eigh(x.T @ x)
            self.axes = v[:, ::-1][:, :dims].astype(np.float32)
        else:
            values, u = np.linalg.eigh(x @ x.T)
            self.axes = (x.T @ u[:, ::-1][:, :dims] / np.sqrt(np.maximum(values[::-1][:dims], 1e-12))).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors of rows whose columns are the used terms."""
        return self._unit((rows * self.weight) @ self.axes)


def _term_rows(df: DataFrame) -> DataFrame:
    """i, label and the non-zero terms, for the sample."""
    kind = df.schema["i"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [terms(t.as_py() or b"") for t in batch.column(2)]
            where = [np.flatnonzero(f) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(where, pa.list_(pa.int32())), pa.array([f[w] for f, w in zip(found, where, strict=True)], pa.list_(pa.float32()))], names=["i", "label", "at", "x"])

    return df.select("i", "label", "t").mapInArrow(run, f"i {kind}, label int, at array<int>, x array<float>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dims: int = DIMS) -> tuple[Latent | None, np.ndarray, np.ndarray]:
    """Projection, labelled vectors and labels, from `sample` labels at most."""
    given = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL")
    given = given.where(~held_out("i"))
    ids = docs.select(F.col(id_col).alias("i"))
    chosen = given.join(ids, "i", "left_semi").distinct().orderBy(F.xxhash64("i"), "i", "label").limit(sample)
    text = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    taught = text.join(F.broadcast(chosen), "i").groupBy("i", "label").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("least"))
    rows = _term_rows(taught.select("i", "label", F.col("least.t").alias("t"))).orderBy("i", "label").toArrow()
    if not rows.num_rows:
        return None, np.zeros((0, dims), np.float32), np.zeros(0)
    at, x = rows.column("at").combine_chunks(), rows.column("x").combine_chunks()
    seen = np.bincount(at.flatten().to_numpy(), minlength=TERMS)
    used = np.flatnonzero(seen >= min(LEAST_ROWS, rows.num_rows))
    column = np.full(TERMS, -1)
    column[used] = np.arange(len(used))
    row = np.repeat(np.arange(rows.num_rows), np.diff(at.offsets.to_numpy()))
    place = column[at.flatten().to_numpy()]
    matrix = np.zeros((rows.num_rows, len(used)), np.float32)
    matrix[row[place >= 0], place[place >= 0]] = x.flatten().to_numpy()[place >= 0]
    latent = Latent(matrix, used, dims)
    return latent, latent.vectors(matrix), rows.column("label").to_numpy().astype(float)


def _scores(texts: pa.Array, latent: Latent | None, vectors: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Scores of one block of documents."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if latent is None or not len(texts):
        return np.full(len(texts), prior)
    near = min(k, len(labels))
    own = latent.vectors(np.stack([terms(t.as_py() or b"")[latent.used] for t in texts]))
    cosines = np.round(own @ vectors.T, 5)
    least = np.partition(cosines, len(labels) - near, axis=1)[:, len(labels) - near]
    weight = np.where(cosines >= least[:, None], np.maximum(cosines, 0), 0).astype(float) ** SHARPNESS
    total = weight.sum(1)
    return np.clip(np.where(total > 0, weight @ labels / np.maximum(total, 1e-12), prior), 0, 1)


def score(df: DataFrame, model: tuple[Latent | None, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS) -> DataFrame:
    """One row per document: id, score."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(part.column(1), *sent.value, k))], names=["id", "score"])

    kept = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep(df: DataFrame, model: tuple[Latent | None, np.ndarray, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold;
    decided where they are read, without a shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at_text = df.columns.index(text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                good = _scores(part.column(at_text).cast(pa.binary()), *sent.value, k) >= threshold
                yield part.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Learn and score every document: id, held_out, score, predicted."""
    found = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
