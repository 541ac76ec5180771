import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import zstandard
from tokenizers import Tokenizer

from lodestar.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_files_read_back_as_written(docs, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    manifest = token_files.write_tokens(docs, PATH, f"file://{tmp_path}/t")
    found = sorted(token_files.read_tokens(manifest, with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for (doc_id, text), r in zip(rows, found, strict=True):
        want = library.encode(text, add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, at, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    some = token_files.read_tokens(manifest, only={7}).collect()
    assert [r["doc_id"] for r in some] == [7]


def test_empty_table(nothing, tmp_path):
    assert token_files.read_tokens(token_files.write_tokens(nothing, PATH, f"file://{tmp_path}/t")).count() == 0


def write(path, docs, width=4):
    with pafs.LocalFileSystem().open_output_stream(str(path)) as out:
        writer = token_files.Writer(out, width)
        for i, ids in docs:
            writer.add(i, iter([np.array(ids, "<u4").tobytes()]))
        writer.close()


def test_only_asked_frames_are_read_and_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 4096)
    rng = np.random.default_rng(0)
    docs = [(i, rng.integers(0, 49408, n).tolist()) for i, n in enumerate([10, 5000, 0, 3, 2000])]
    for width in (2, 4):
        write(tmp_path / "f", docs, width)
        reader = token_files.Reader(pa.memory_map(str(tmp_path / "f")))
        loaded = []
        plain = reader._load
        reader._load = lambda k: (loaded.append(k), plain(k))[1]
        assert np.frombuffer(b"".join(reader.pieces(3)), "<u4").tolist() == docs[3][1]
        assert len(set(loaded)) == 1 and len(reader.table) >= 4
        for i, ids in docs:
            assert np.frombuffer(b"".join(reader.pieces(i)), "<u4").tolist() == ids
    body = bytearray((tmp_path / "f").read_bytes())
    # The whole is plain zstandard: any reader of the format gets all ids.
    everything = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(body))
    assert np.frombuffer(everything, "<u4").tolist() == [x for _, ids in docs for x in ids]
    reader.table = reader.table.copy()
    reader.table[0, 2] ^= 1
    reader.frame = -1
    with pytest.raises(ValueError, match="checksum"):
        list(reader.pieces(0))
    body[-1] ^= 1
    (tmp_path / "g").write_bytes(body)
    with pytest.raises(ValueError, match="seek table"):
        token_files.Reader(pa.memory_map(str(tmp_path / "g")))
