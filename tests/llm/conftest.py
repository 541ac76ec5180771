import pytest

TEXTS = {
    1: "Hello world, hello again.",
    2: None,
    3: "",
    4: "   \n\t ",
    5: "same text here twice",
    6: "same text here twice",
    7: "ünïcödé Straße ΑΣ İ é x<|endoftext|>y 12 34!! 'tis we'll",
    8: "a" * 3000,
    9: "word " * 3000,
    10: "1.2.3.4 mail a.b@c.de +1 (555) 123-4567 and 4111 1111 1111 1111",
    11: "same text here twice",
}


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, a repeated row, a null id, and extra
    columns whose names the operators use themselves."""
    rows = [(k, v, "en" if k % 2 else None, None, None, "x", 1, 2, 3, 4, 5, 6) for k, v in TEXTS.items()]
    rows += [rows[4], (None, "no id", None, None, None, None, None, None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, digest string, id int, row int, mark int, fp int, key int, bucket int"
    return spark.createDataFrame(rows, kind).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, id int, row int")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(sample):
    return {r["doc_id"]: r["text"] or "" for r in sample.select("doc_id", "text").collect()}
