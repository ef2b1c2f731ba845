"""Queries against their SQL on events with keys and counts that the given tables lack."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def both(spark, folder, name, rows):
    """A query's rows and its SQL's, sorted."""
    spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    return sorted(map(tuple, df.select(*names).collect())), sorted(found.fetchall())


def event(i, user, kind="view", value=6.5, hour=0):
    return (i, dt.datetime(2024, 1, 1, hour, i % 60, tzinfo=dt.timezone.utc), user, kind, value, None)


def test_made_addresses_hold_ids_of_any_length(spark, tmp_path):
    ids = [1, 2, 7, 8, 65528, 65534, 65536, 65542, 99996, 5_999_994, (1 << 62) + 5, (1 << 63) - 7]
    got, wanted = both(spark, tmp_path, "ip_validity", [event(i, i % 1500) for i in ids])
    assert got == wanted


def test_union_sums_the_slots_of_dense_nodes(spark, tmp_path):
    """Nodes with more slots than the sparse form holds still count by their slots."""
    got, wanted = both(spark, tmp_path, "sketch_union", [event(i, i // 4) for i in range(4 * 4500)])
    assert got == wanted


def test_stream_counts_the_slots_of_dense_nodes(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "stream_sketches", [event(4 * i, i) for i in range(4500)])
    assert got == wanted


def test_time_to_detect_is_zero_without_an_attack_window(spark, tmp_path):
    none, wanted = both(spark, tmp_path / "none", "time_to_detect", [event(i, i) for i in range(20)])
    assert none == wanted == [(0.0,)]
    empty, wanted = both(spark, tmp_path / "empty", "time_to_detect", [])
    assert empty == wanted == [(0.0,)]
    unseen, wanted = both(spark, tmp_path / "unseen", "time_to_detect", [event(i, i, "error") for i in range(3)])
    assert unseen == wanted == [(0.0,)]
