import pytest

from lodestar.operators import metrics


def scored(spark, true, predicted, base, admitted=()):
    rows = spark.createDataFrame([(0, t, p) for t, p in zip(true, predicted, strict=True)], "session_id int, true_label string, predicted_label string")
    known = spark.createDataFrame([(0, a) for a in admitted], "session_id int, label string")
    return metrics.session_metrics(rows, base, known).first()


@pytest.mark.parametrize(
    ("true", "predicted", "base", "admitted", "expected"),
    [
        # Inputs and results that published code gives too.
        ("abzz", ["a", "b", "unknown", "unknown"], ["a", "b"], (), {"ccr": 1.0, "tur": 1.0, "os_hm": 1.0}),
        ("azz", ["a", "a", "a"], ["a"], (), {"tur": 0.0, "os_hm": 0.0}),
        ("ac", ["a", "c"], ["a"], ("c",), {"n_true_known": 2, "ccr": 1.0}),
        ("aaz", ["a", "unknown", "unknown"], ["a"], (), {"ccr": 0.5, "tur": 1.0, "os_hm": 0.6667}),
    ],
)
def test_scorer(spark, true, predicted, base, admitted, expected):
    row = scored(spark, true, predicted, base, admitted).asDict()
    assert {k: row[k] for k in expected} == expected


def test_perfect_macro_f1_counts_unknown(spark):
    assert scored(spark, "abz", ["a", "b", "unknown"], ["a", "b"])["macro_f1_with_unknown"] == 1.0


def test_auroc_and_aupr_of_perfect_and_tied_scores(spark):
    good = spark.createDataFrame([(True, 3.0), (True, 2.0), (False, 1.0)], "u boolean, s double")
    assert metrics.auroc(good, [], "u", "s").first()[0] == 1.0
    assert metrics.aupr(good, [], "u", "s").first()[0] == 1.0
    tied = spark.createDataFrame([(True, 1.0), (False, 1.0)], "u boolean, s double")
    assert metrics.auroc(tied, [], "u", "s").first()[0] == 0.5


def test_summary_without_rows(spark):
    empty = spark.createDataFrame([], "true_label string, predicted_label string, accepted boolean, score double, threshold double")
    row = metrics.summary(empty, ["a"]).first()
    assert row["total_rows"] == 0 and row["overall_open_set_accuracy"] == 0.0 and row["unknown_rejection_auroc"] is None
    assert not metrics.run_metrics(spark.createDataFrame([], "n_true_unknown long, os_hm double, ccr double, tur double, f1_unknown double, macro_f1_with_unknown double")).first()["os_hm"]
