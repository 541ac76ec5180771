import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4095, 4096, 4097, 12345])
def test_lengths_are_powers_of_two_that_sum_up(n):
    found = packing.lengths(n, 4096)
    assert sum(found) == n and found == sorted(found, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 4096 for x in found)


def test_pieces_cover_each_document_once(docs, nothing):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH, 64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    by = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["doc_id"]].append(r)
    for d in docs.collect():
        want = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by[d["doc_id"]], key=lambda r: r["start"])
        pieces = pieces[::2] if d["doc_id"] == 5 else pieces  # that row is there twice
        assert [i for p in pieces for i in p["ids"]] == want and {p["doc_tokens"] for p in pieces} == {len(want)}
    assert all(r["length"] == 1 << r["bucket"] for r in rows)
    again = packing.pack(docs.repartition(7, "text"), PATH, 64).collect()
    key = lambda r: (r["sequence_id"], str(r["doc_id"]), r["start"], r["ids_crc32"])
    assert sorted(map(key, again)) == sorted(map(key, rows))  # whatever the layout
    buckets = sorted((r["sequence_id"], r["length"]) for r in rows)
    assert [n for _, n in buckets] == sorted(n for _, n in buckets)
    assert packing.pack(nothing, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, 100)


def test_cuts_of_many_documents_are_each_ones_lengths():
    sizes = np.array([1, 64, 65, 127, 0, 200, 63, 128])
    of, start, length = packing._cut(sizes, 64)
    for i, n in enumerate(sizes):
        mine = length[of == i].tolist()
        assert mine == packing.lengths(int(n), 64) and start[of == i].tolist() == np.cumsum([0, *mine])[: len(mine)].tolist()
