from lodestar.llm import winnowing


def test_half_shared_short_texts_share_entries(spark):
    rows = [(n, " ".join(f"w{n}x{i:02d}" for i in range(n))) for n in range(6, 24)]
    found = winnowing.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and all(r["near_edited"] > 0 and r["near_next"] == 0 for r in found)
