"""Fill-in-middle by a parallel automaton scan.

A text is cut in tokens, `[A-Za-z]+|[^A-Za-z]`. One automaton over its UTF-8
bytes counts where tokens begin and whether a marker (`<P>`, `<S>`, `<M>`)
stands in it. Chunks do not know in which state they are entered, so each
yields its state-transition function and its counts for every entry state;
functions are composed in order, which gives every chunk its entry state and
the tokens before it; and only the chunk that holds a cut looks for its place.

A document of at most `chunk` bytes is one chunk and never leaves its task.
Chunks of longer ones are dealt over all tasks, both to be counted and to be
cut, and what comes out is a row for each part: no task holds a giant document,
and digests of it are taken as its parts pass by in order.

Defined cases: a null text counts as empty; an empty one is plain with no
tokens; a null id draws as the empty text; rows that repeat an id are
transformed each, and alike; an empty table gives an empty result; other columns
may have any name and are not carried. A text that holds a marker is plain,
wherever chunks begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.automaton import Automaton, Pieces
from lodestar.llm.common import fresh_path

#: Bytes of a chunk, and of the texts that a task reads together.
CHUNK, TOGETHER = 1 << 16, 1 << 20
#: Per cent of documents that stay as they are, and of the others that put the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
MARKERS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
#: The order of sections in the output of each form, and in the text.
SECTIONS = {"psm": "PSM", "spm": "SPM"}
TEXT_ORDER = "PMS"

OUTSIDE, LETTERS, OPENED, NAMED = range(4)
SAME, LETTER, NAME, OPEN, CLOSE, OTHER = range(6)


def _automaton() -> Automaton:
    """States: outside letters, in letters, after `<`, after `<` and P, S or M.
    Continuation bytes change nothing. Counters: token starts, markers."""
    classes = np.full(256, OTHER, np.uint8)
    classes[0x80:0xC0] = SAME
    for first in "Aa":
        classes[ord(first) : ord(first) + 26] = LETTER
    for marker in MARKERS.values():
        classes[marker[1]] = NAME
    classes[ord("<")], classes[ord(">")] = OPEN, CLOSE
    step, tokens, markers = (np.zeros((6, 4), np.int64) for _ in range(3))
    step[SAME] = range(4)
    step[LETTER] = step[NAME] = LETTERS
    step[NAME, OPENED] = NAMED
    step[OPEN] = OPENED
    tokens[OPEN:] = 1
    tokens[[[LETTER], [NAME]], [OUTSIDE, OPENED]] = 1
    markers[CLOSE, NAMED] = 1
    return Automaton(classes, step, (tokens, markers))


AUTOMATON = _automaton()


def draws(ids: Column) -> list[Column]:
    """Four numbers below 2**32 that the id alone decides."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(ids.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _forms(n: np.ndarray, marked: np.ndarray, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The form, and the two cuts in tokens."""
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    form = np.where(h[3] % 100 < SPM_BELOW, "spm", "psm")
    return np.where((n == 0) | marked | (h[2] % 100 >= PLAIN_FROM), "plain", form), cuts


def _chars(text: bytes) -> int:
    """Code points: bytes that continue none."""
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


PARTS = "key long, id {id}, n long, form string, part long, prefix_chars long, middle_chars long, output binary"


def _batch(columns: list, id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["key", "id", "n", "form", "part", "prefix_chars", "middle_chars", "output"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _blocks(batch: pa.RecordBatch, text: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each."""
    sizes = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for s, e in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield batch.slice(s, e - s)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one chunk: count, cut and put together where they are read."""
    for batch in batches:
        for part in _blocks(batch, 1):
            texts, ids = part.column(1).to_pylist(), part.column(0).to_pylist()
            h = [part.column(2 + i).to_numpy() for i in range(4)]
            pieces = Pieces(AUTOMATON, texts)
            _, (tokens, markers) = pieces.functions()
            n = tokens[:, OUTSIDE]
            form, cuts = _forms(n, markers[:, OUTSIDE] > 0, h)
            places = pieces.find(np.full(len(texts), OUTSIDE), cuts)
            out: list[tuple] = []
            for text, shape, a, b in zip(texts, form.tolist(), *places.tolist(), strict=True):
                if shape == "plain":
                    out.append((None, None, text))
                    continue
                sections = {"P": text[:a], "M": text[a:b], "S": text[b:]}
                out.append((_chars(text[:a]), _chars(text[a:b]), b"".join(MARKERS[x] + sections[x] for x in SECTIONS[shape])))
            yield _batch([[None] * len(texts), ids, n, form.tolist(), [0] * len(texts), *zip(*out, strict=True)], part.column(0).type)


def _chunked(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, text = batch.slice(i, 1), memoryview(batch.column(1)[i].as_buffer())
                for at in range(0, len(text), 64 * chunk):
                    found = [bytes(text[s : s + chunk]) for s in range(at, min(at + 64 * chunk, len(text)), chunk)]
                    same = [row.column(j).take(pa.array([0] * len(found))) for j in (0, 2, 3, 4, 5, 6)]
                    place = pa.array([at // chunk + j for j in range(len(found))], pa.int64())
                    yield pa.RecordBatch.from_arrays([*same, place, pa.array(found, pa.binary())], names=["id", "h1", "h2", "h3", "h4", "key", "place", "piece"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk its function: exits and counts by entry state."""
    names = ["key", "place", "exits", "tokens", "markers"]
    lists = lambda x, kind: pa.array(list(x), pa.list_(kind))
    for batch in batches:
        for part in _blocks(batch, 2):
            exits, (tokens, markers) = Pieces(AUTOMATON, part.column(2).to_pylist()).functions()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(exits, pa.int32()), lists(tokens, pa.int64()), lists(markers, pa.int64())], names=names)


def _composed(group: pa.Table) -> pa.Table:
    """Compose a document's functions, one small row for each chunk, in order."""
    group = group.sort_by("place")
    rows = group.num_rows
    exits, tokens, markers = (np.array(group.column(c).to_pylist()) for c in ("exits", "tokens", "markers"))
    state, before, marked = np.zeros(rows + 1, np.int64), np.zeros(rows + 1, np.int64), 0
    for i in range(rows):
        state[i + 1] = exits[i, state[i]]
        before[i + 1] = before[i] + tokens[i, state[i]]
        marked += int(markers[i, state[i]])
    columns = [group.column("key"), group.column("place"), state[:-1], before[:-1], np.full(rows, before[-1]), np.full(rows, marked > 0)]
    return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["key", "place", "state", "before", "n", "marked"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that know how they are entered, cut into parts of the output."""
    for batch in batches:
        for block in _blocks(batch, 2):
            key, place, texts, ids, *rest = (block.column(i).to_pylist() for i in range(4))
            state, before, n, marked, *h = (block.column(i).to_numpy(zero_copy_only=False) for i in range(4, 12))
            form, cuts = _forms(n, marked, h)
            places = Pieces(AUTOMATON, texts).find(state, cuts - before)
            out: list[tuple] = []
            for i, text in enumerate(texts):
                shape, (a, b) = str(form[i]), places[:, i].tolist()
                head = (key[i], ids[i], int(n[i]), shape)
                if shape == "plain":
                    out.append((*head, place[i] + 1, None, None, text))
                    continue
                sections = {"P": text[:a], "M": text[a:b], "S": text[b:]}
                for j, x in enumerate(SECTIONS[shape]):
                    if place[i] == 0:
                        out.append((*head, j << 40, 0, 0, MARKERS[x]))
                    if sections[x]:
                        size = _chars(sections[x])
                        out.append((*head, (j << 40) + place[i] + 1, size if x == "P" else 0, size if x == "M" else 0, sections[x]))
            yield _batch(list(zip(*out, strict=True)), block.column(3).type)


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """key, id, n (tokens), form, part, prefix_chars, middle_chars, output.

    A document of one chunk is one row with a null key and its whole output.
    A longer one has a key of its own and a row for each part; parts in order
    are the output, and the numbers of characters add up over them (null if
    plain)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *draws(F.col(id_col)))
    kind = PARTS.format(id=rows.schema["id"].dataType.simpleString())
    whole = rows.where(F.octet_length("text") <= chunk).mapInArrow(_whole, kind)
    giant = rows.where(F.octet_length("text") > chunk).withColumn("key", F.monotonically_increasing_id())
    id_type = rows.schema["id"].dataType.simpleString()
    dealt = giant.mapInArrow(_chunked(chunk), f"id {id_type}, h1 long, h2 long, h3 long, h4 long, key long, place long, piece binary")
    path = fresh_path(spark, "chunks")
    dealt.repartition("key", "place").write.parquet(path)  # keys are fixed from here on
    chunks = spark.read.parquet(path)
    counted = chunks.select("key", "place", "piece").mapInArrow(_counted, "key long, place long, exits array<int>, tokens array<long>, markers array<long>")
    entered = counted.groupBy("key").applyInArrow(_composed, "key long, place long, state long, before long, n long, marked boolean")
    known = chunks.join(entered, ["key", "place"]).select("key", "place", "piece", "id", "state", "before", "n", "marked", "h1", "h2", "h3", "h4")
    return whole.unionByName(known.mapInArrow(_cut, kind))


def restored(output: bytes, form: str) -> bytes:
    """The text of a whole output."""
    if form == "plain":
        return output
    found: dict[str, bytes] = {}
    rest = output
    for x, after in zip(SECTIONS[form], [*SECTIONS[form][1:], ""], strict=True):
        if not rest.startswith(MARKERS[x]):
            raise ValueError("an output does not have the markers of its form")
        found[x], _, tail = rest[3:].partition(MARKERS[after]) if after else (rest[3:], b"", b"")
        rest = MARKERS[after] + tail if after else b""
    return b"".join(found[x] for x in TEXT_ORDER)


DIGESTS = "id {id}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_NAMES = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, form = b.column(7).to_pylist(), b.column(3).to_pylist()
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (1, 2, 3, 5, 6)), sha(out), sha(map(restored, out, form))], names=_NAMES)


_PASSING = "key long, id {id}, n long, form string, place long, prefix_chars long, middle_chars long, output_sha256 string, piece binary"
#: The place of a document's summary: after all its parts.
LAST = 1 << 62


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order of output: take its digest as they pass, and give each
    part its place in the text, told from the markers alone."""
    now, last, section, count, sha, prefix, middle = None, None, "P", 0, hashlib.sha256(), 0, 0
    names = ["key", "id", "n", "form", "place", "prefix_chars", "middle_chars", "output_sha256", "piece"]

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int64(), kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def summary() -> tuple:
        plain = last[3] == "plain"
        return (*last, LAST, None if plain else prefix, None if plain else middle, sha.hexdigest(), None)

    kind = pa.int64()
    for b in batches:
        for block in _blocks(b, 7):
            kind, out = block.column(1).type, []
            for key, i, n, form, _, p, m, piece in zip(*(block.column(j).to_pylist() for j in range(8)), strict=True):
                if key != now:
                    if last is not None:
                        out.append(summary())
                    now, last, section, count, sha, prefix, middle = key, (key, i, n, form), "P", 0, hashlib.sha256(), 0, 0
                sha.update(piece)
                prefix, middle, count = prefix + (p or 0), middle + (m or 0), count + 1
                mark = next((x for x, marker in MARKERS.items() if piece == marker), None) if form != "plain" else None
                if mark:
                    section = mark
                else:
                    out.append((*last, (TEXT_ORDER.index(section) << 40) + count, None, None, None, piece))
            if out:
                yield batch(out, kind)
    if last is not None:
        yield batch([summary()], kind)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256()
    for b in batches:
        out, kind = [], b.column(1).type
        for i, place in enumerate(b.column(4).to_pylist()):
            if place != LAST:
                sha.update(b.column(8)[i].as_buffer())
                continue
            out.append((*(b.column(j)[i].as_py() for j in (1, 2, 3, 5, 6, 7)), sha.hexdigest()))
            sha = hashlib.sha256()
        if out:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_NAMES)


def digests(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of `transform`: id, n, form, prefix_chars,
    middle_chars, output_sha256, and restored_sha256 of the text that output
    and form give back."""
    kind = parts.schema["id"].dataType.simpleString()
    whole = parts.where(F.col("key").isNull()).mapInArrow(_digested, DIGESTS.format(id=kind))
    ordered = parts.where(F.col("key").isNotNull()).repartition("key").sortWithinPartitions("key", "part")
    passed = ordered.mapInArrow(_passing, _PASSING.format(id=kind)).sortWithinPartitions("key", "place")
    return whole.unionByName(passed.mapInArrow(_rebuilt, DIGESTS.format(id=kind))).withColumnRenamed("id", id_col)
