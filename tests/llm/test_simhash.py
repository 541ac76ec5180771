import random
import re

import pytest
import xxhash

from lodestar.llm import simhash


def brute_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_and_components_match_brute_force(sample, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    found = {r["doc_id"]: r for r in simhash.components(sample).collect()}
    assert {i: found[i]["fingerprint"] for i in fps} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: found[i]["component_id"] for i in fps} == want


@pytest.mark.parametrize("hot", [50_000, 2])
def test_links_connect_all_close_pairs(spark, hot):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:10] * 6:
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(r["src"] & (1 << 64) - 1, r["dst"] & (1 << 64) - 1) for r in simhash.links(nodes, hot=hot).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    want = brute_components({f: f for f in fps})
    parent = {f: f for f in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {f: find(f) for f in fps} == want


def test_every_anchor_is_reached_within_its_radius(spark):
    rng = random.Random(1)
    rows = simhash.anchored(spark.createDataFrame([(rng.getrandbits(63),) for _ in range(200)], "fp long")).collect()
    for r in rows:
        half, anchor = r["key"] >> 31, r["key"] & (1 << 31) - 1
        away = (((r["fp"] >> 32 * half) & (1 << 31) - 1) ^ anchor).bit_count()
        assert away <= (1 if r["held"] else 2)
    assert sum(r["held"] for r in rows) == 400


def test_blocks_change_nothing(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 100)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())


def test_defined_cases(docs, nothing):
    found = simhash.components(docs).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r for r in found}
    assert by[2]["fingerprint"] == "0" * 16 and by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) >= {1, 2, 5, None} and not set(ids) & {3, 4, 6, 11}
    assert kept.count() == len({r["component_id"] for r in found})
    assert simhash.components(nothing).count() == 0 and simhash.drop_near_copies(nothing).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs.select("fp"), most=4)


def test_components_that_share_an_id_keep_a_row_each(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "one two three four five"), (1, "one two three four five"), (2, "alpha beta gamma delta")], "doc_id long, text string")
    kept = simhash.drop_near_copies(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "alpha beta gamma delta"), (1, "one two three four five")]


@pytest.mark.parametrize("hot", [50_000, 5])
def test_many_fingerprints_that_share_a_half(spark, hot):
    """Those that only pass an anchor are split, and no link is lost."""
    rng = random.Random(8)
    base = rng.getrandbits(63)
    fps = {base ^ rng.getrandbits(31) << 32 for _ in range(60)}
    for f in list(fps)[:30]:
        fps |= {f ^ 1 << rng.randrange(32), f ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32), f ^ 1 << rng.randrange(32, 63)}
    nodes = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    if hot == 5:
        assert simhash.anchored(nodes, hot).where("part > 0").count() > 0
    parent = {f: f for f in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in simhash.links(nodes, hot=hot).collect():
        assert 0 < (r["src"] ^ r["dst"]).bit_count() <= 3
        x, y = sorted((find(r["src"]), find(r["dst"])))
        parent[y] = x
    assert {f: find(f) for f in fps} == brute_components({f: f for f in fps})
