"""Token-id files: independent zstandard frames with a trailing seek table.

A file is plain zstandard: data frames of whole unsigned little-endian ids,
then a skippable frame with the document index, then the seek table of the
public seekable format (a skippable frame: compressed size, size and the low
half of the XXH64 of each frame's data, then a footer). A reader loads both
tables from the file's end and decompresses only the frames that hold what is
asked for, checking each one's checksum.

Documents are range-partitioned by id and each partition becomes one file under
its attempt's own name. The manifest (one row for each file), materialised in the
shared folder, names the files that hold; what a lost or repeated task leaves
besides is never read. A file's first position follows from the counts before it.

Defined cases: a null text counts as empty and yields the end id alone; null
ids come first; rows that repeat an id are kept, ordered by their text's hash; a
text of any length is encoded a slice at a time and continues over frames; other
columns may have any name and are not carried. An empty table gives a manifest without documents and an empty read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.bpe import encoder
from lodestar.llm.common import cut, fresh_path, open_fs

#: Bytes of ids in a frame; a longer document continues in the next frames.
FRAME = 1 << 20
#: Fixed values of the public zstandard formats: skippable frames (document
#: index, seek table) and the seek table's footer.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80


class Writer:
    """Streams documents into one file; holds one frame and the index."""

    def __init__(self, out, width: int = 4, level: int = 3):
        self.out, self.width, self.level = out, width, level
        self.frame, self.table, self.docs, self.ids = bytearray(), [], [], 0

    def add(self, doc_id: int | None, pieces: Iterator[bytes]) -> None:
        """pieces: unsigned little-endian 32-bit ids."""
        start = self.ids
        for piece in pieces:
            self.ids += len(piece) // 4
            self.frame += piece if self.width == 4 else np.frombuffer(piece, "<u4").astype("<u2").tobytes()
            while len(self.frame) >= FRAME:
                self._flush(FRAME)
        self.docs.append((doc_id is not None, doc_id or 0, start, self.ids - start))

    def _flush(self, n: int) -> None:
        data = bytes(self.frame[:n])
        del self.frame[:n]
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(data)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)

    def close(self) -> None:
        if self.frame:
            self._flush(len(self.frame))
        columns = zip(*self.docs, strict=True) if self.docs else ((), (), (), ())
        arrays = [np.array(c, d).tobytes() for c, d in zip(columns, ("<u1", "<i8", "<u8", "<u8"), strict=True)]
        index = struct.pack("<BQ", self.width, len(self.docs)) + zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(b"".join(arrays))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        rows = b"".join(struct.pack("<III", *t) for t in self.table)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), CHECKSUMS, FOOTER_MAGIC))


class Reader:
    """Random access to one file; one decompressed frame is held at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        rows = self._at(size - 9 - 12 * frames, 12 * frames)
        self.table = np.frombuffer(rows, "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.sizes = np.concatenate([[0], np.cumsum(self.table[:, 1], dtype=np.int64)])
        magic, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index")
        index = self._at(int(self.starts[-1]) + 8, length)
        self.width, n = struct.unpack_from("<BQ", index)
        data = zstandard.ZstdDecompressor().decompress(index[9:], max_output_size=max(1, 25 * n)) if n else b""
        at, self.columns = 0, []
        for kind, wide in (("<u1", 1), ("<i8", 8), ("<u8", 8), ("<u8", 8)):
            self.columns.append(np.frombuffer(data, kind, n, at))
            at += wide * n
        self.frame, self.data = -1, b""

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.columns[0])

    def _load(self, k: int) -> bytes:
        if k != self.frame:
            packed = self._at(int(self.starts[k]), int(self.table[k, 0]))
            data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.table[k, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.table[k, 2]):
                raise ValueError(f"checksum of frame {k} does not match")
            self.frame, self.data = k, data
        return self.data

    def pieces(self, i: int) -> Iterator[bytes]:
        """Ids of document i as little-endian unsigned 32-bit bytes, by frame."""
        at = int(self.columns[2][i]) * self.width
        end = at + int(self.columns[3][i]) * self.width
        while at < end:
            k = int(np.searchsorted(self.sizes, at, side="right")) - 1
            inside = at - int(self.sizes[k])
            part = self._load(k)[inside : inside + end - at]
            at += len(part)
            yield part if self.width == 4 else np.frombuffer(part, "<u2").astype("<u4").tobytes()

    def doc_id(self, i: int) -> int | None:
        return int(self.columns[1][i]) if self.columns[0][i] else None


def write_tokens(df: DataFrame, vocab: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts with the library, append `end_id`, write one file for
    each range of ids. Returns the manifest: part, path, docs, ids, base."""
    spark = df.sparkSession
    folder = (folder or fresh_path(spark, "tokens")).rstrip("/")
    last = struct.pack("<I", end_id)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab, library=True)
        width = 2 if max(coder.merges.text) < 1 << 16 and end_id < 1 << 16 else 4
        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"ids-{part:08d}-{uuid.uuid4().hex}.zst"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            writer = Writer(out, width)
            for batch in rows:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    pieces = coder.ids_of(text.as_py() or "")
                    writer.add(doc_id.as_py(), (p for ps in (pieces, (last,)) for p in ps))
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (f"{folder}/{name}", pa.string()), (len(writer.docs), pa.int64()), (writer.ids, pa.int64()))], names=["part", "path", "docs", "ids"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = texts.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    manifest = cut(order.mapInArrow(run, "part int, path string, docs long, ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return cut(manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))))


def read_tokens(manifest: DataFrame, with_ids: bool = False, only: set[int] | None = None) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and,
    if asked for, `ids`. `only`: decompress the frames of these documents alone."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    wanted = [i for i in range(len(reader)) if only is None or reader.doc_id(i) in only]
                    for at in range(0, len(wanted), 256 if with_ids else 8192):
                        some, sums, ids = wanted[at : at + (256 if with_ids else 8192)], [], []
                        for i in some:
                            crc, kept = 0, []
                            for piece in reader.pieces(i):
                                crc = zlib.crc32(piece, crc)
                                if with_ids:
                                    kept += np.frombuffer(piece, "<u4").tolist()
                            sums.append(crc)
                            ids.append(kept)
                        arrays = [pa.array([reader.doc_id(i) for i in some], pa.int64()), pa.array(reader.columns[2][some].astype(np.int64) + base), pa.array(reader.columns[3][some].astype(np.int64)), pa.array(sums, pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return files(manifest).mapInArrow(run, kind)


def files(manifest: DataFrame) -> DataFrame:
    """The manifest's files, spread over tasks."""
    session: SparkSession = manifest.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    return manifest.where("docs > 0").repartitionByRange(parts, "part").select("path", "base")
