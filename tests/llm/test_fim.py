import hashlib
import random
import re

import numpy as np
import pytest

from lodestar.llm import fim
from lodestar.llm.automaton import Pieces

WHOLE = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(i, text):
    """The contract in plain Python."""
    text = text or ""
    tokens = WHOLE.findall(text)
    n = len(tokens)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * j : 8 * j + 8], 16) for j in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, sha(text), sha(text))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h[3] % 100 < 20
    return (i, n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def tidy(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_outputs_match_plain_code(spark, chunk):
    rng = random.Random(1)
    pool = ["a", "B", "z", "S", "P", "M", "<", ">", "<P>", "é", "日", "𝛼", " ", "\n", "1", "word", "the"]
    rows = [(i, "".join(rng.choices(pool, weights=[4] * 6 + [1, 1, 0.05] + [4] * 8, k=rng.choice([0, 1, 2, 5, 30, 300])))) for i in range(400)]
    rows += [(400, None), (None, "no id at all, but text"), (7, rows[7][1]), (401, "x" * 5000), (402, "é" * 700), (403, "<P" * 200), (404, "ab<S" + ">" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = fim.digests(fim.transform(df, chunk=chunk))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert tidy(found.collect()) == tidy(brute(i, t) for i, t in rows)


def test_parts_in_order_are_the_output(spark):
    rows = [(i, "Some words, 12 of them; " * 40) for i in range(30)]
    parts = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), chunk=50).collect()
    assert all(len(p["output"]) <= 50 for p in parts)
    for i, text in rows:
        own = sorted((p for p in parts if p["id"] == i), key=lambda p: p["part"])
        output = b"".join(p["output"] for p in own)
        assert fim.restored(output, own[0]["form"]).decode() == text
        assert hashlib.sha256(output).hexdigest() == brute(i, text)[5]


def test_nulls_ties_repeats_clashing_names(docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for chunk in (16, 1 << 16):
        assert tidy(fim.digests(fim.transform(docs, chunk=chunk)).collect()) == tidy(brute(*r) for r in rows)
    assert fim.digests(fim.transform(nothing)).count() == 0


def test_functions_compose_wherever_a_text_is_cut():
    text = "ab <P>c é<Mé> Zz9<S>\n<P".encode() * 9
    whole, (tokens, markers) = Pieces(fim.AUTOMATON, [text]).functions()
    for at in range(len(text) + 1):
        exits, (t, m) = Pieces(fim.AUTOMATON, [text[:at], text[at:]]).functions()
        for state in range(4):
            between = exits[0, state]
            assert exits[1, between] == whole[0, state]
            assert t[0, state] + t[1, between] == tokens[0, state] and m[0, state] + m[1, between] == markers[0, state]


def test_find_gives_token_starts():
    text = "Hello  wörld, it's <x> 日本 ok"
    starts = [len(text[: m.start()].encode()) for m in WHOLE.finditer(text)]
    pieces = Pieces(fim.AUTOMATON, [text.encode(), b""])
    for number, at in enumerate([*starts, len(text.encode())]):
        assert pieces.find(np.zeros(2, np.int64), np.array([[number, number]]))[0].tolist() == [at, 0]


def test_broken_output_is_refused():
    with pytest.raises(ValueError):
        fim.restored(b"no markers", "psm")
