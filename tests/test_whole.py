"""Operators read the whole of what they are given."""

import pytest

from lodestar.plans.catalog_reports import LETTERS, letter_features


def test_letters_are_counted_over_the_whole_text(spark, monkeypatch):
    monkeypatch.setattr("lodestar.plans.catalog_reports.COUNTED", 1000)
    docs = spark.createDataFrame([(1, "a" * 4000 + "B" * 6000 + "é" * 2000, "en")], "doc_id long, text string, lang string")
    x = dict(zip(LETTERS, letter_features(docs).first()["x"], strict=True))
    assert (x["a"], x["b"], x["c"]) == pytest.approx((4000 / 12000, 6000 / 12000, 0))
