"""Queries against their SQL where values tie."""

import duckdb
import pytest

from spliceflow.queries import ORACLE_SQL, QUERIES


def rows_of(spark, folder, name, view):
    duck = duckdb.connect()
    duck.execute(f"create view {view} as select * from '{folder}/{view}.parquet/*.parquet'")
    want = duck.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).select(cols).collect())
    assert got == sorted(want.fetchall()), cols
    return got


def test_a_flat_top_is_no_peak(spark, tmp_path):
    x = [0.0, 90.0, 90.0, 1.0, 95.0, 2.0, 80.0, 80.0, 80.0, 0.0, 50.0, 0.0]
    df = spark.range(24).selectExpr("id event_id", "cast(timestamp'2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, 0, id) as timestamp_ntz) ts", "id div 12 user_id", "'view' event_type", f"element_at(array({', '.join(map(str, x))}), cast(id % 12 + 1 as int)) value", "'' props")
    df.selectExpr("event_id", "ts", "user_id", "event_type", "cast(value as double) value", "props").write.parquet(f"{tmp_path}/events.parquet")
    assert rows_of(spark, tmp_path, "m4_find_peaks", "events") == [(0, 4, 95.0), (0, 10, 50.0), (1, 4, 95.0), (1, 10, 50.0)]


@pytest.mark.parametrize("name", ["p7_path_transitions", "s8_splice_rows"])
def test_paths_with_the_same_cuts_in_another_order_cost_the_same(spark, tmp_path, name):
    """Two orders of two jumps of track 3 add up to the same cost, in sums of another order: the first cuts decide."""
    spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("label = 3").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of(spark, tmp_path, name, "embeddings")
