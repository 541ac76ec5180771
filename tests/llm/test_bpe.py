import hashlib
import random
import struct
import tracemalloc
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(text, coder=None):
    return [i for part in (coder or bpe.encoder(PATH)).ids_of(text) for i in part]


def test_long_words_stream_to_the_librarys_ids(library):
    rng = random.Random(2)
    pieces = [t.removesuffix("</w>") for t in bpe.encoder(PATH).merges.vocab if t.isascii() and t.isalpha()]
    for letters in ("ab", "th", "aeiou", "thequickbrown", "!?."):
        word = "".join(rng.choice(letters) for _ in range(4000))
        assert ids(word) == library.encode(word, add_special_tokens=False).ids
    for _ in range(50):
        word = "".join(rng.choice(pieces) for _ in range(300))
        assert ids(word) == library.encode(word, add_special_tokens=False).ids


def test_window_stays_bounded():
    merges = bpe.encoder(PATH).merges
    most = 0

    def watched(symbols, plain=merges.merge):
        nonlocal most
        most = max(most, len(symbols))
        return plain(symbols)

    merges.merge = watched
    try:
        assert sum(1 for _ in merges.transduce(b"thequick" * 20_000)) > 0
    finally:
        del merges.merge
    assert most <= merges.lookahead + bpe.BLOCK + 1


def test_slices_change_nothing(library, monkeypatch):
    text = "Él niño, it's 12 ok!! " * 50 + "x" * 400 + "<|endoftext|> énd"
    whole = ids(text)
    monkeypatch.setattr(bpe, "SLICE", 64)
    assert ids(text) == whole == library.encode(text, add_special_tokens=False).ids


def test_round_trip_matches_the_library(docs, library):
    found = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    for r in docs.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        row = found[r["doc_id"]]
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_tables(docs, nothing, library):
    coded = bpe.encode_texts(docs, PATH)
    assert coded.count() == docs.count()
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(coded, PATH, readable=True).collect()}
    assert back[1] == "hello world , hello again . " and back[2] == ""
    assert bpe.round_trip(nothing, PATH).count() == 0 and bpe.encode_texts(nothing, PATH).count() == 0


def test_bytes_become_text_only_when_complete():
    machine = bpe.ByteToText()
    data = "é€😀".encode()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.close() == "é€😀"
    assert machine.feed(b"\xe2\x82") + machine.close() == "�"


def test_library_words_equal_the_transducer(texts):
    fast = bpe.encoder(PATH, library=True)
    for t in list(texts.values())[:60]:
        assert b"".join(fast.ids_of(t)) == b"".join(i.to_bytes(4, "little") for i in ids(t))


def packed(text):
    data = b"".join(bpe.encoder(PATH, library=True).ids_of(text))
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def check(library, texts):
    """Both ways of encoding give the library's ids."""
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(text) == want.ids and packed(text) == want.ids, ascii(text)


POINTS = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
MARKS = [c for c in POINTS if unicodedata.category(chr(c))[0] == "M"]


def test_every_code_point(library):
    some = [f"a{chr(c)} b{chr(c)}{chr(c)}1 {chr(c)}x" for c in POINTS if c < 0x20000 or unicodedata.category(chr(c)) not in ("Cn", "Co")]
    check(library, ["\n".join(some[i : i + 40]) for i in range(0, len(some), 40)])


def test_marks_and_compositions(library):
    check(library, [" ".join(f"a{chr(a)}{m} b{m}{chr(a)} {chr(a)}{m}" for m in "̴̱́") for a in MARKS])
    check(library, [" ".join(chr(c) + chr(m) for m in range(0x300, 0x370)) for c in range(0x41, 0x530)])
    whole = [chr(c) for c in POINTS if (d := unicodedata.decomposition(chr(c))) and d[0] != "<"]
    whole += [unicodedata.normalize("NFD", c) for c in whole]
    check(library, [j.join(whole[i : i + 20]) for i in range(0, len(whole), 20) for j in ("", " x")])


@pytest.mark.parametrize("small", [False, True])
def test_random_mixtures(library, monkeypatch, small):
    """With small slices, words and marks cross every cut."""
    if small:
        monkeypatch.setattr(bpe, "SLICE", 16)
        monkeypatch.setattr(bpe, "LONG", 12)
    rng = random.Random(5)
    drawn = [POINTS[0x20:0x3000], MARKS + [0x41, 0x49, 0x130, 0x20, 9], [*range(0x20, 0x7F)], [ord(c) for c in "'strevmld Aa1 !."], [*range(0x1100, 0x1200), 0xAC00, 0xAC01, 0x20]]
    texts = ["".join(chr(rng.choice(rng.choice(drawn) if k % 2 else drawn[k % 5])) for _ in range(rng.randint(1, 120))) for k in range(4000)]
    check(library, [t.replace(" ", "") if small and k % 3 else t for k, t in enumerate(texts)])


def test_a_long_text_without_blanks_is_held_a_slice_at_a_time(library):
    for unit in ("thequickbrownfox", "the,quick;brown-fox+", "йе"):
        text = unit * (1_000_000 // len(unit))
        tracemalloc.start()
        n = sum(map(len, bpe.encoder(PATH).ids_of(text)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n > 50_000 and peak < 30 << 20
        check(library, [text[:200_000]])
