import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import search
from lodestar.llm.common import fresh_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k, parts=3):
    folder = search.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), fresh_path(spark, "index"))
    result = search.search(spark.read.parquet(folder), spark.createDataFrame(items, "item_id long, text string"), k)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in result.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=rng.choice([1, 3, 10, 80])))) for i in range(700)]
    docs += [(1000 + i, "copy of w3 w9 w50") for i in range(90)]  # many equal scores
    docs += [(2000, None), (2001, ""), (2002, "... !!"), (None, "w3 w9 w50 no id"), (5, docs[5][1]), (5, "w50 w50"), (2003, "w7 " * 200_000 + "rare")]
    items = [(1, "w1 w2 w2 W59"), (2, "w3 w9 w50"), (3, None), (4, "--"), (5, "nowhere"), (6, "É 日本 x1"), (7, "rare w7 w0"), (8, " ".join(words)), (None, "w50"), (2, "w3 w9 w50")]
    return docs, items


@pytest.mark.parametrize(("documents", "k"), [(4096, 20), (50, 3), (50, 100_000)])
def test_matches_scoring_all(spark, corpus, documents, k, monkeypatch):
    monkeypatch.setattr(search, "DOCUMENTS", documents)
    docs, items = corpus
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_blocks_of_items_and_layouts_do_not_matter(spark, corpus, monkeypatch):
    docs, items = corpus
    first = found(spark, docs, items, 5)
    monkeypatch.setattr(search, "ITEM_CHARS", 100)
    monkeypatch.setattr(search, "CELLS", 500)
    monkeypatch.setattr(search, "POSTINGS", 40)
    assert found(spark, docs[::-1], items, 5, 2) == first


def test_bytes_bound_impacts_from_both_sides():
    tf, n = np.meshgrid(np.array([1, 2, 3, 10, 1000, 10**6]), np.array([1, 5, 100, 10**6, 10**8]))
    tf, n = tf.ravel(), n.ravel()
    exact = search.impacts(tf, n, 1000, 50_000)
    level = -(-exact // search.STEP)
    assert level.max() <= 255 and (level * search.STEP >= exact).all() and ((level - 1) * search.STEP < np.maximum(exact, 1)).all()


def test_terms_across_slices(monkeypatch):
    text = "Alpha beta-gamma délta 12 " * 9 + "x" * 100
    whole = search.counted(text.encode())
    assert whole == Counter(t.encode() for t in terms(text))
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(search, "SLICE", size)
        assert search.counted(text.encode()) == whole and search.terms_in(memoryview(text.encode())) == whole.total()
    assert search.terms_in(memoryview(b"")) == 0 == search.terms_in(memoryview(b" .!"))


def test_nulls_clashing_names_and_empty_tables(spark, docs, nothing):
    items = [(1, "hello world"), (2, "same text")]
    folder = search.build(docs, fresh_path(spark, "index"))
    result = search.search(spark.read.parquet(folder), spark.createDataFrame(items, "item_id long, text string"), 20)
    assert sorted((tuple(r) for r in result.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items, 20)
    empty = search.build(nothing, fresh_path(spark, "index"))
    assert search.search(spark.read.parquet(empty), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert search.search(spark.read.parquet(folder), nothing.select(nothing.doc_id.alias("item_id"), "text")).count() == 0


def test_each_segment_is_a_row_group_of_its_own(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(search, "DOCUMENTS", 10)  # the JVM side is what counts: no writer or reader holds two segments
    docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "concat('term', id % 7, ' word', id) AS text")
    folder = search.build(docs, str(tmp_path / "index"))
    held = [pq.ParquetFile(f).metadata for f in (tmp_path / "index").glob("*.parquet")]
    assert sum(m.num_rows for m in held) == sum(m.num_row_groups for m in held) > 1
    items = spark.createDataFrame([(1, "word13 term6")], "item_id long, text string")
    found = search.search(spark.read.parquet(folder), items, 3).orderBy("rank").collect()
    assert found[0]["doc_id"] == 13 and len(found) == 3
