"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut into pieces whose lengths are the
powers of two that add up to its length, each at most the sequence length:
full sequences first, then falling powers. Every piece is a sequence of its
own, so none crosses documents and none is padded.

Pieces of equal length form a bucket (the power). One exchange deals them by
bucket and slot (a hash of document and place, SLOTS for each bucket, so none
is one task's), and there they are numbered in order of id and place. So a
batch of one length is drawn from one place, and a sequence id (from its high
bits down: bucket, slot, number) is the same however the input is laid out or
how often a task is repeated.

Defined cases: a null text counts as empty and is its end id alone; rows that
repeat an id are packed each; a very long document is held by one worker, as
its 4-byte ids; other columns may have any name and are not carried; an empty
table gives no sequences.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.bpe import encoder

#: Slots of each bucket, and the bits of a number within a slot.
SLOTS, NUMBER_BITS = 1 << 14, 40
SLOT_BITS = 14


def lengths(n: int, longest: int) -> list[int]:
    """Falling powers of two that sum to n, none above `longest`."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _cut(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece, in order, for many documents."""
    powers = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    full, rest = sizes // longest, sizes % longest
    parts = np.where(rest[:, None] & powers, powers, 0)
    starts = (full * longest)[:, None] + np.cumsum(parts, 1) - parts
    some = parts > 0
    whole = np.repeat(np.arange(len(sizes)), full)
    first = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    of = np.concatenate([whole, np.repeat(np.arange(len(sizes)), some.sum(1))])
    start = np.concatenate([first * longest, starts[some]])
    length = np.concatenate([np.full(len(whole), longest), parts[some]])
    order = np.lexsort((start, of))
    return of[order], start[order], length[order]


def pack(df: DataFrame, vocab: str, sequence: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset (0: each piece is a whole sequence), bucket and, if asked for, ids;
    clustered by bucket."""
    if sequence & (sequence - 1) or not 1 < sequence < 1 << 30:
        raise ValueError("the sequence length is a power of two")
    last = struct.pack("<I", end_id)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab, library=True)
        for batch in rows:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [b"".join((*coder.ids_of(t or ""), last)) for t in part.column(1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                of, start, length = _cut(sizes, sequence)
                flat = memoryview(b"".join(found))
                ends = np.cumsum(length) * 4
                crc = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), (length * 4).tolist(), strict=True)]
                arrays = [part.column(0).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[of])]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends // 4]), pa.int32()), pa.array(np.frombuffer(flat, "<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = f"id {texts.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = texts.mapInArrow(run, kind).withColumn("bucket", (F.bit_count(F.col("length") - 1)).cast("int"))
    pieces = pieces.withColumn("slot", F.pmod(F.xxhash64("id", "start"), F.lit(SLOTS)))
    number = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("id", "start", "ids_crc32")).cast("long") - 1
    high = F.shiftleft(F.shiftleft(F.col("bucket").cast("long"), SLOT_BITS).bitwiseOR(F.col("slot")), NUMBER_BITS)
    pieces = pieces.withColumn("sequence_id", high.bitwiseOR(number)).withColumn("offset", F.lit(0).cast("long"))
    return pieces.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *["ids"] * with_ids)
