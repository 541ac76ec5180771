import hashlib
from collections import defaultdict

import pytest

from lodestar.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    key = lambda i: -1 if i is None else i
    return sorted((key(i), key(max(groups[t or ""], key=key)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("share", [1 / 1024, 0.1])
def test_decisions_match_brute_force(docs, share):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = exact_dedup.decide(docs, share=share).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r["doc_id"]), key(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found) == expected(rows)
    assert sum(r["kept"] for r in found) == len({t or "" for _, t in rows})


def test_heavy_digests_are_all_found_and_exact(spark):
    texts = [f"t{i % 7}" if i % 3 else "hot" for i in range(3000)] + [f"rare{i}" for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    rows = df.select(df.doc_id.alias("id"), exact_dedup.digest(df.text).alias("digest"), df.doc_id.alias("row"))
    heavy = exact_dedup.heavy_digests(exact_dedup.cut(rows), 0.05).collect()
    assert len(heavy) <= 40 and {r["n"] for r in heavy if r["n"] >= 200} == {texts.count(t) for t in set(texts) if texts.count(t) >= 200}


@pytest.mark.parametrize("share", [1 / 1024, 0.1])
def test_one_row_of_each_text_stays_with_its_columns(docs, share):
    kept = exact_dedup.drop_copies(docs, share=share)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({r["text"] or "" for r in docs.collect()})
    assert [r["doc_id"] for r in rows if r["text"] == "same text here twice"] == [11]


def test_empty_table(nothing):
    assert exact_dedup.decide(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0
