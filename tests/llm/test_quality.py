import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import quality


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_accuracy(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    model = quality.train(docs, labels)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).where(f"score >= {quality.THRESHOLD}").count()


def test_votes_equal_brute_force(spark, sample, labels):
    """The whole query against plain loops: terms of the sample, rarity, the
    decomposition by numpy's SVD, cosines one by one, ties at the k-th place."""
    taught = {r["doc_id"]: r["quality"] for r in labels.collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in sample.collect()}
    train = sorted(i for i in texts if i in taught and zlib.crc32(str(i).encode()) % 5)
    assert len(train) > 20
    found = {r["doc_id"]: r["score"] for r in quality.classify(sample, labels).collect()}
    rows = np.array([quality.terms(texts[i]) for i in train])
    used = (rows > 0).sum(0) >= quality.LEAST_ROWS
    rows = rows[:, used]
    weight = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 0.1

    def unit(v):
        return v / max(1e-12, np.linalg.norm(v))

    axes = np.linalg.svd(np.array([unit(r * weight) for r in rows]), full_matrices=False)[2][: quality.DIMS]
    vectors = [unit(axes @ (r * weight)) for r in rows]
    assert set(found) == set(texts)
    for i in sorted(texts):
        own = unit(axes @ (quality.terms(texts[i])[used] * weight))
        cosines = [round(float(own @ v), 5) for v in vectors]
        least = sorted(cosines)[-quality.NEIGHBOURS]
        votes = [(max(0.0, c) ** quality.SHARPNESS, taught[j]) for c, j in zip(cosines, train, strict=True) if c >= least]
        total = sum(w for w, _ in votes)
        want = sum(w * y for w, y in votes) / total if total else np.mean([taught[j] for j in train])
        assert found[i] == pytest.approx(want, abs=0.01), i


def test_terms_equal_brute_force():
    text = "Éa 12, the the\nΩ日本語 x" * 3
    data = text.encode()
    kinds = [int(quality.CLASS_OF[b]) for b in data]
    shapes = Counter(zip(kinds, kinds[1:], kinds[2:], strict=False))
    got = quality.terms(data)
    for (a, b, c), n in shapes.items():
        assert got[(a * quality.CLASSES + b) * quality.CLASSES + c] == pytest.approx((n / sum(shapes.values())) ** 0.5, abs=1e-5)
    content = Counter()
    for i in range(len(data) - 3):
        h = sum((data[i + j] + 1 + 32 * (65 <= data[i + j] <= 90)) * int(f) for j, f in enumerate(quality.FACTORS)) & 0xFFFFFFFF
        content[((h ^ h >> 15) * int(quality.FACTORS[0]) & 0xFFFFFFFF) >> 22] += 1
    for h, n in content.items():
        assert got[quality.SHAPES + h] == pytest.approx(quality.CONTENT * (n / sum(content.values())) ** 0.5, abs=1e-5)


def test_equal_neighbours_all_vote():
    import pyarrow as pa

    texts = [b"one two three", b"one two three", b"ONE TWO! 3", b"ONE TWO! 3", b"4 4 4 4 4"]
    rows = np.array([quality.terms(t) for t in texts])
    used = np.arange(quality.TERMS)
    latent = quality.Latent(rows, used, 4)
    # The nearest of the first text is itself and its copy, whatever k = 1 would pick.
    got = quality._scores(pa.array(texts[:1]), latent, latent.vectors(rows), np.array([1.0, 0, 0, 0, 1]), 1)
    assert got[0] == pytest.approx(0.5, abs=1e-3)


def test_latent_vectors():
    rng = np.random.default_rng(0)
    rows = rng.random((40, 6)).astype(np.float32)
    latent = quality.Latent(rows, np.arange(6), 4)
    assert np.allclose(np.linalg.norm(latent.vectors(rows), axis=1), 1, atol=1e-5)
    wide = quality.Latent(rng.random((5, 9)).astype(np.float32), np.arange(9), 3)
    assert wide.axes.shape == (9, 3)


def test_repeated_documents_and_order_change_nothing(spark, sample, labels):
    once = {r["doc_id"]: r["score"] for r in quality.classify(sample, labels).collect()}
    twice = quality.classify(sample.unionByName(sample).repartition(5, "text"), labels.unionByName(labels)).collect()
    assert len(twice) == 2 * len(once) and all(abs(r["score"] - once[r["doc_id"]]) < 0.01 for r in twice)


def test_a_very_long_text(spark, labels, sample):
    long = spark.createDataFrame([(1, "word " * 600_000)], "doc_id long, text string")
    (row,) = quality.score(long, quality.train(sample, labels)).collect()
    assert 0 <= row["score"] <= 1


def test_defined_cases(spark, docs, nothing, labels):
    no_labels = labels.where("false")
    assert {r["score"] for r in quality.classify(docs, no_labels).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1, None), (9, 0, 1), (7, None, None), (12, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, some).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality.classify(nothing, labels).count() == 0
    assert quality.keep(docs, quality.train(docs, no_labels)).count() == docs.count()


def test_slices_keep_terms(monkeypatch):
    text = b"word word Other!! 12 " * 500
    whole = quality.terms(text)
    monkeypatch.setattr(quality, "SLICE", 1000)
    assert np.allclose(quality.terms(text), whole)
