import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import winnowing


def hashed(spark, words):
    rows = spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", F.xxhash64("w")).collect()
    return {r[0]: r[1] & (1 << 64) - 1 for r in rows}


def parted(text):
    """Words, and the characters of long ones."""
    return [x for w in text.split() for x in (w if len(w) > winnowing.LONG else [w])]


def brute(text, of, k=winnowing.K, w=winnowing.W):
    words = parted(text)
    rot = lambda x, n: (x << n | x >> (64 - n)) & (1 << 64) - 1 if n else x
    grams = []
    for i in range(max(len(words) - k + 1, min(len(words), 1))):
        g = 0
        for j in range(k):
            if i + j < len(words):
                g ^= rot(of[words[i + j]], k - 1 - j)
        grams.append(g >> 32)
    chosen = []
    for i in range(max(len(grams) - w + 1, min(len(grams), 1))):
        window = grams[i : i + w]
        at = max(j for j, g in enumerate(window) if g == min(window)) + i
        if not chosen or chosen[-1] != (grams[at], at):
            chosen.append((grams[at], at))
    return chosen


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_matches_brute_force(spark, sample, texts, buckets):
    some = dict(sorted(texts.items())[:40]) | {1000: "", 1001: "one", 1002: "one two three four", 1004: "北京大学是一所著名的大学，位于中国北京市海淀区𝛼𝛽。" * 3, 1005: "abcdefghijklm short abcdefghijkl", 1003: "a a a a a a a a a a a a a a a a a a a a a a"}
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r for r in winnowing.fingerprint_documents(df, buckets=buckets).collect()}
    order = sorted(some, reverse=True)
    edited = {}
    for i, d in enumerate(order):
        text, following = some[d], some[order[(i + 1) % len(order)]]
        edited[d] = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
    of = hashed(spark, {w for t in [*some.values(), *edited.values()] for w in parted(t)})
    for i, d in enumerate(order):
        own, changed, following = brute(some[d], of), brute(edited[d], of), brute(some[order[(i + 1) % len(order)]], of)
        r = found[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(some[d]), hashlib.sha256(edited[d].encode()).hexdigest())
        assert r["fingerprint"] == ",".join(f"{h:x}:{p}" for h, p in own)
        assert r["edited_fingerprint"] == ",".join(f"{h:x}:{p}" for h, p in changed)
        assert r["near_edited"] == pytest.approx(like(own, changed)) and r["near_next"] == pytest.approx(like(own, following))


def test_shared_runs_are_guaranteed_a_match(spark):
    shared = " ".join(f"s{i}" for i in range(winnowing.K + winnowing.W - 1))
    texts = [(i, " ".join(f"x{i}{j}" for j in range(i * 3)) + " " + shared + f" y{i}") for i in range(8)]
    df = winnowing.with_fingerprint(spark.createDataFrame(texts, "i long, text string"), "text", "fp")
    sets = [set(r[0]) for r in df.select(winnowing.hashes(F.col("fp"))).collect()]
    assert all(a & b for a in sets for b in sets)


def test_defined_cases(docs, nothing, spark):
    found = winnowing.fingerprint_documents(docs).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r for r in found}
    assert by[2]["fingerprint"] == "" and by[2]["n_chars"] == 0 and by[5]["fingerprint"] == by[6]["fingerprint"]
    assert by[3]["near_next"] == 1.0
    alone = winnowing.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0
    assert winnowing.fingerprint_documents(nothing).count() == 0


def test_plan_is_native(sample):
    plan = winnowing.fingerprint_documents(sample)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_half_changed_texts_without_blanks_share_entries(spark):
    import random

    rng = random.Random(2)
    rows = [(i, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randint(30, 200)))) for i in range(60)]
    found = winnowing.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["near_edited"] > 0 for r in found) >= 54 and all(r["near_next"] < 0.05 for r in found)
