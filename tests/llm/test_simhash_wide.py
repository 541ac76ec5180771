"""Near copies at a similarity of 0.8: plain loops over shingles are the truth."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodestar.llm import simhash_wide as wide


def brute_shingles(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_groups(texts):
    """The smallest id of each text's group, by exact similarities of all pairs
    that share a shingle and an anchor in any band (nine in ten of those at 0.8)."""
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    signs = wide._signs()
    prints = {i: wide.wide([wide.shingles(t.encode())], signs) for i, t in texts.items()}

    def meet(a, b):
        near = np.bitwise_count(prints[a][0, wide.BANDS :] ^ prints[b][0, wide.BANDS :]).sum() <= wide.MEET
        return near and (wide.homes(prints[a]) == wide.homes(prints[b])).any()

    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(h[i], h[j]) for h in holders.values() for j in range(len(h)) for i in range(j)}:
        if similarity(sets[a], sets[b]) >= 0.8 and meet(a, b):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in texts}


def edited(rng, words, share):
    words = list(words)
    for i in rng.sample(range(len(words)), max(1, round(share * len(words)))):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    """Texts of 20 to 400 words and one edited copy of each; similarities from 0.5 to 0.98."""
    rng, texts = random.Random(8), {}
    vocabulary = [f"w{i}" for i in range(3000)]
    for i in range(0, 600, 2):
        words = rng.choices(vocabulary, k=rng.randint(20, 400))
        texts[i] = " ".join(words)
        texts[i + 1] = " ".join(edited(rng, words, rng.uniform(0.002, 0.06)))
    return texts


def test_shingles_equal_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "B", "cc", "\u00e9"], k=n)) for n in [0, 1, 2, 4, 5, 6, 9, 40, 200]]
    assert [len(wide.shingles(t.encode())) for t in texts] == [len(brute_shingles(t)) for t in texts]
    for a in texts:
        for b in texts:
            both = np.intersect1d(wide.shingles(a.encode()), wide.shingles(b.encode()))
            assert len(both) == len(brute_shingles(a) & brute_shingles(b))
    long = " ".join(rng.choices("abcdefghij", k=700_000))
    assert len(wide.shingles(long.encode())) == len(brute_shingles(long))


def test_anchors_are_words_of_the_covering_code():
    words = np.random.default_rng(1).integers(0, 2**32, (50, wide.BANDS + wide.CHECK), dtype=np.uint32)
    keys = wide.homes(words)
    code = (keys & 0x7FFFFFFF).astype(np.uint32)
    assert (np.bitwise_count(code ^ (words[:, : wide.BANDS] & 0x7FFFFFFF)) <= 1).all()
    for word in code.ravel().tolist():
        s = 0
        for p in range(1, 32):
            s ^= p * (word >> (p - 1) & 1)
        assert s == 0
    assert (keys >> 31 == np.arange(wide.BANDS)).all()


def test_recall_and_precision_of_links(spark, corpus):
    df = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    found = {r["id"]: r["component"] for r in wide.groups(df).collect()}
    sets = {i: brute_shingles(t) for i, t in corpus.items()}
    near = [i for i in range(0, 600, 2) if similarity(sets[i], sets[i + 1]) >= 0.8]
    far = [i for i in range(0, 600, 2) if i not in near]
    assert len(near) > 60 and len(far) > 60
    assert sum(found[i] == found[i + 1] for i in near) >= 0.9 * len(near)
    assert not any(found[i] == found[i + 1] for i in far)
    assert len(set(found.values())) >= 300


def test_a_dense_group_is_one_and_yields_few_links(spark):
    rng = random.Random(5)
    base = rng.choices([f"w{i}" for i in range(900)], k=300)
    texts = [(i, " ".join(edited(rng, base, 0.004))) for i in range(1500)] + [(9999, "something else altogether that stands alone")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = wide.fingerprints(df).cache()
    assert wide.links(df, rows).count() < 40 * len(texts)
    assert {r["doc_id"] for r in wide.drop_near_copies(df).collect()} == {0, 9999}


def test_defined_cases(spark):
    schema = "doc_id long, text string, id long, `set` string, words string, mark int"
    same = "one two three four five six seven"
    texts = [None, "", " \n", same, same.upper(), same.replace(" ", "  "), "one two", "One Two", "x" * 300_000, same, "one two three"]
    given = [(i, t, 1, "s", "w", 2) for i, t in enumerate(texts)] + [(3, same, 1, "s", "w", 2), (None, same, 5, "s", "w", 2)]
    out = wide.drop_near_copies(spark.createDataFrame(given, schema))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 3, 6, 8, 10]
    assert out.columns == ["doc_id", "text", "id", "set", "words", "mark"]
    assert wide.drop_near_copies(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("shared", [0.6, 0.69])
def test_pages_of_one_template_hide_no_near_copies(spark, shared):
    """Pairs at 0.8 to 0.9 among pages that are all like each other at `shared`,
    in small batches and two layouts; the truth is plain Jaccard."""
    rng = random.Random(11)
    own = round(400 * (1 - shared) / (1 + shared))
    template = [f"t{i}" for i in range(400 - own)]
    page = lambda: template + [f"w{rng.randrange(10**9)}" for _ in range(own)]
    texts = {i: page() for i in range(1500)}
    pairs = []
    while len(pairs) < 60:
        words = page()
        other = edited(rng, words, rng.uniform(0.010, 0.022))
        if 0.8 <= similarity(brute_shingles(" ".join(words)), brute_shingles(" ".join(other))) <= 0.9:
            pairs.append((len(texts), len(texts) + 1))
            texts |= dict(zip(pairs[-1], (words, other), strict=True))
    assert abs(similarity(brute_shingles(" ".join(texts[0])), brute_shingles(" ".join(texts[1]))) - shared) < 0.03
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    former = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        found = []
        for layout in (1, 2):
            order = list(texts)
            random.Random(layout).shuffle(order)
            df = spark.createDataFrame([(i, " ".join(texts[i])) for i in order], "doc_id long, text string").repartition(3 + layout)
            got = {r["id"]: r["component"] for r in wide.groups(df).collect()}
            found.append({frozenset(i for i in got if got[i] == c) for c in set(got.values())})
    finally:
        spark.conf.set(key, former)
    assert found[0] == found[1]
    place = {i: g for g in found[0] for i in g}
    assert sum(place[a] == place[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(len(place[i]) == 1 for i in range(1500))
