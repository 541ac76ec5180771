"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
import pytest
from tests.llm.test_simhash_wide import brute_groups

from lodestar.llm import pii
from lodestar.llm.queries import ORACLES, QUERIES, VOCAB

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('stages')}"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "pii", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_rejects_junk_and_keeps_the_rest(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert sum((i in after) == bool(labels[i]) for i in labels if i in before) >= 0.95 * len(labels)


def test_exact_and_near_copies(stages):
    before, after = rows(stages[1]), rows(stages[2])
    best = {}
    for i, r in before.items():
        best[r["text"]] = max(i, best.get(r["text"], -1))
    assert set(after) == set(best.values())
    groups = brute_groups({i: r["text"] or "" for i, r in after.items()})
    assert set(rows(stages[3])) == set(groups.values())


def test_personal_data_goes_and_all_else_stays(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not any(pii.base_spans(r["text"]).values()) and r["n_chars"] == len(r["text"])
        (_, spans), = pii._found([before[i]["text"]], pii.judge())
        assert spans or r["text"] == before[i]["text"]


def test_packing_holds_all_ids(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCAB)
    pieces = {}
    for r in stages[5].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, r in rows(stages[4]).items():
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == library.encode(r["text"], add_special_tokens=False).ids + [2]


def test_run_applies_all_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


def test_every_operator_has_its_query():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, found.fetchall()))
