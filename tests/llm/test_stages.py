"""Each stage alone: nulls, empty and long texts, ties, repeated rows, an empty
table, and columns whose names the operators use themselves."""

import collections

import corpus_pipeline
import pytest

from lodestar.llm import pii
from tests.llm.test_simhash_wide import brute_groups

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(docs):
    """The odd documents twice over, and one with nulls in every column."""
    nothing = docs.sparkSession.createDataFrame([(None,) * len(docs.columns)], docs.schema)
    return docs.unionByName(docs).unionByName(nothing).cache()


@pytest.fixture(scope="module")
def results(spark, odd):
    return {name: stage(spark, odd, SF).cache() for name, stage in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_and_kinds_stay(results, odd, name):
    assert results[name].columns == odd.columns and [f.dataType for f in results[name].schema.fields] == [f.dataType for f in odd.schema.fields]


@pytest.mark.parametrize("name", list(STAGES))
def test_an_empty_table_stays_empty(spark, nothing, name):
    found = STAGES[name](spark, nothing, SF)
    assert found.count() == 0
    if name != "packing":
        assert found.columns == nothing.columns


def test_quality_decides_alike_on_repeated_rows(results, odd):
    before = collections.Counter(map(str, odd.collect()))
    after = collections.Counter(map(str, results["quality"].collect()))
    assert after and all(n == before[k] for k, n in after.items())


def test_quality_without_matching_labels_keeps_all(spark, odd, tmp_path):
    labels = spark.createDataFrame([(-5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    assert STAGES["quality"](spark, odd, f"file://{tmp_path}").count() == odd.count()


def test_exactly_one_of_equal_texts_stays(results, odd):
    best = {}
    for r in odd.collect():
        key = r["text"] or ""
        best[key] = max(best.get(key, -1), -1 if r["doc_id"] is None else r["doc_id"])
    found = results["exact_dedup"].collect()
    assert sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in found) == sorted(best.items())


def test_exactly_one_of_each_component_stays(results, odd):
    texts = sorted({r["text"] or "" for r in odd.collect()})
    groups = brute_groups(dict(enumerate(texts)))
    found = results["simhash"].collect()
    assert sorted(groups[texts.index(r["text"] or "")] for r in found) == sorted(set(groups.values()))
    for r in found:
        same = [x["doc_id"] for x in odd.collect() if groups[texts.index(x["text"] or "")] == groups[texts.index(r["text"] or "")] and x["doc_id"] is not None]
        assert r["doc_id"] == min(same, default=None)


def test_texts_without_personal_data_pass_untouched(results, odd):
    masked = {}
    for r in odd.collect():
        (_, spans), = pii._found([r["text"] or ""], pii.judge())
        masked.setdefault(r["doc_id"], []).append(None if r["text"] is None else pii.masked(r["text"], spans))
    got = {}
    for r in results["pii"].collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    key = lambda x: (x is None, x or "")
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in masked.items()}


def test_every_row_is_packed(results, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.VOCAB)
    want = collections.Counter((r["doc_id"], i) for r in odd.collect() for i in library.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    got = collections.Counter((r["doc_id"], i) for r in results["packing"].collect() for i in r["ids"])
    assert got == want and results["packing"].where("size(ids) <> length").count() == 0
