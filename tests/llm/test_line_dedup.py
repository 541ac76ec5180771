import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key_of(line)].add(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = -1 if i is None else i
        stays = [x for x in lines if len(key_of(x)) < 40 or len(held[key_of(x)]) < 5 or max(held[key_of(x)]) == own]
        out.append((i, len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "A Line that very many documents share, all of it"


@pytest.fixture(scope="module")
def rows():
    rows = [(i, f"first {i}\n  {LONG.upper() if i % 2 else LONG}\r\nlast") for i in range(60)]
    rows += [(100 + i, f"{LONG}\n{LONG} \nshort\n" + "é" * (40 if i % 2 else 39)) for i in range(12)]
    rows += [(200 + i, "in four documents only, so it must stay here") for i in range(4)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, LONG), (None, "x\n" + LONG), (303, " " * 60), (303, " " * 50)]
    rows += [(400, "repeated id and text, which is one document only\n")] * 6 + [(401, "repeated id and text, which is one document only")]
    rows += [(500 + i, "ÄÖÜ" + "İ" * 40 + "\nk" * 3) for i in range(6)]
    rows += [(600, "\n".join([LONG] * 3000)), (601, "\n".join(f"line number {i} of a very long text, here" for i in range(4000)))]
    rows += [(700 + i, "\n".join(f"line number {j} of a very long text, here" for j in range(i, 4000, 7))) for i in range(5)]
    return rows


@pytest.mark.parametrize("hot", [1, 2048])
def test_matches_plain_code(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in line_dedup.listing(df).collect()), key=str) == brute(rows)


def test_other_columns_pass_and_untouched_texts_stay(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit(1), "pos": F.lit("p"), "_lines": F.lit(2.0), "mark": F.lit(None).cast("int")})
    found = line_dedup.drop_lines(df)
    assert found.columns == [*df.columns, "n_lines", "n_dropped"]
    texts = [r["text"] for r in found.collect() if r["doc_id"] == 300]
    assert texts == [None]
    again = line_dedup.drop_lines(found.drop("n_lines", "n_dropped"))
    assert again.agg(F.sum("n_dropped")).first()[0] == 0


def test_nulls_clashing_names_and_empty_tables(docs, nothing):
    assert sorted((tuple(r) for r in line_dedup.listing(docs).collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert line_dedup.listing(nothing).count() == 0


def test_no_python_and_no_whole_lines_in_the_counting_shuffles(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = line_dedup.keyed_lines(df, "doc_id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup.keyed_lines(df, "doc_id", "text").columns == ["id", "mark", "pos", "hash"]
