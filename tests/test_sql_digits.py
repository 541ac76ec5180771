"""Queries that have to round and add as their SQL does, on rows where it shows."""

import duckdb
import pytest

from lodestar.plans.catalog import ORACLES, QUERIES


def sides(spark, name, folder):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    return sorted(map(repr, map(tuple, QUERIES[name](spark, str(folder)).select(*names).collect()))), sorted(map(repr, found.fetchall()))


def write(folder, rows):
    duckdb.connect().execute(f"COPY ({rows}) TO '{folder}/events.parquet' (FORMAT parquet)")


def test_decayed_weights_equal_sql_for_large_ids(spark, tmp_path):
    write(tmp_path, "SELECT i * 37 AS event_id, i % 150 AS user_id, (i * 7919) % 56021 / 100.0::DOUBLE AS value FROM range(0, 30000) t(i)")
    got, want = sides(spark, "decay_prune", tmp_path)
    assert len(got) > 25_000 and got == want


def test_missing_weights_and_times_are_dropped(spark):
    from lodestar.operators import admission

    rows = spark.createDataFrame([(1, 1.0, 5), (2, None, 5), (3, 1.0, None)], "i int, w double, t long")
    assert [r["i"] for r in admission.decayed(rows, 10.0, 0.001, 0.5).collect()] == [1]


@pytest.mark.parametrize("partitions", [1, 7])
def test_step_down_values_equal_sql_at_halves(spark, tmp_path, partitions):
    write(tmp_path, "SELECT i AS event_id, i % 1000 AS user_id, (i * 7919 + i // 1000) % 56021 / 100.0::DOUBLE AS value FROM range(0, 64000) t(i)")
    if partitions > 1:
        spark.read.parquet(f"{tmp_path}/events.parquet").repartition(partitions).write.parquet(f"{tmp_path}/more/events.parquet")
    got = sorted(map(repr, map(tuple, QUERIES["holm_stepdown"](spark, f"{tmp_path}/more" if partitions > 1 else str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    assert got == sorted(map(repr, con.execute(ORACLES["holm_stepdown"]).fetchall()))
