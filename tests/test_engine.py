import datetime as dt
import importlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brookwatch.operators import online
from brookwatch.operators import windows as W
from brookwatch.sources.packets import csv_packets, is_attack
from brookwatch.streaming.windows import traffic_stream


def test_entry_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if (Path(entry.__file__).parent / "brookwatch" / "llm").exists():
        found = {n.split("_")[0] for n in entry.queries()}
        assert {f"op{i}" for i in range(1, 11)} | {"pipeline"} <= found


def test_only_missing_parts_are_passed_over(monkeypatch):
    """A mistake inside the optional parts is an error, not a silent loss of their queries."""
    real = importlib.import_module

    def broken(name, *rest):
        if name == "brookwatch.llm.queries":
            raise ImportError("cannot import name 'x' from 'brookwatch.llm.common'", name="brookwatch.llm.common")
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ImportError):
        entry._optional()

    def missing(name, *rest):
        if name == "brookwatch.llm.queries":
            raise ModuleNotFoundError("no module", name="brookwatch.llm")
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert entry._optional() is None


@pytest.mark.parametrize("scores, states", [([0.8] * 3, [0, 0, 1]), ([0.8, 0.8, 0.3, 0.8, 0.8], [0] * 5)])
def test_state_machine_confirms(spark, scores, states):
    rows = spark.createDataFrame([("n", i, s) for i, s in enumerate(scores)], "node_id string, window_start int, score double")
    assert [r.state for r in online.states(rows).orderBy("window_start").collect()] == states


def test_state_machine_recovers_and_is_forced(spark):
    rows = spark.createDataFrame([("n", i, s) for i, s in enumerate([0.8] + [0.3] * 5 + [0.8, 0.3, 0.8])], "node_id string, window_start int, score double")
    out = online.states(rows, confirm=1)
    assert [r.state for r in out.orderBy("window_start").collect()] == [1, 2, 2, 2, 2, 0, 1, 2, 1]
    assert [(r.window_start, r.was, r.state) for r in W.latest(W.transitions(out), 2).orderBy("window_start").collect()] == [(7, 1, 2), (8, 2, 1)]
    forced = rows.withColumn("forced", F.when(F.col("window_start") == 2, 1))
    assert [r.state for r in online.states(forced).orderBy("window_start").collect()][:5] == [0, 0, 1, 2, 2]
    names = spark.createDataFrame([(0,), (1,), (2,), (99,)], "state int").select(W.state_name(F.col("state")).alias("n")).collect()
    assert [r.n for r in names] == ["NORMAL", "UNDER_ATTACK", "RECOVERY", "UNKNOWN"]


def test_zscore_spike_and_short_history(spark):
    rows = spark.createDataFrame([("n", i, 100) for i in range(20)] + [("n", 20, 5000), ("m", 0, 50000)], "node_id string, window_start int, sources long")
    assert [(r.node_id, r.window_start) for r in W.z_scores(rows).filter("alert").collect()] == [("n", 20)]


def test_labels(spark):
    rows = spark.createDataFrame([("BENIGN",), ("Syn",), (None,), ("0",), ("",)], "l string")
    assert [r[0] for r in rows.select(is_attack(F.col("l"))).collect()] == [False, True, False, False, False]


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,src_ip,label,attack_type,byte_len\n2024-01-01 00:00:01,1.1.1.1,x,,0\n5.0, 2.2.2.2 ,x,,9\n,,x,,9\n")
    want = [(dt.datetime(2024, 1, 1, 0, 0, 1), "1.1.1.1", 64), (dt.datetime(1970, 1, 1, 0, 0, 5), "2.2.2.2", 9)]
    assert [(r.ts, r.src_ip, r.byte_len) for r in csv_packets(spark, str(tmp_path)).orderBy("src_ip").collect()] == want
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "b.csv").write_text("7,x,1.2.3.4\n8,y,host\n")
    rows = csv_packets(spark, str(tmp_path / "more"), columns={"src_ip": 2, "timestamp": 0}, header=False).orderBy("ts").collect()
    assert [(r.src_ip, r.byte_len, r.label) for r in rows] == [("1.2.3.4", 64, ""), ("1.48.245.169", 64, "")]
    assert csv_packets(spark, str(tmp_path / "more"), columns={"src_ip": 2}, header=False, max_rows=1).count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(dt.datetime(2024, 1, 1), "n", f"1.1.1.{i}", 64) for i in range(5)], "ts timestamp, node_id string, src_ip string, byte_len long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, node_id string, src_ip string, byte_len long").parquet(str(tmp_path / "in"))
    run = traffic_stream(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r.packets, r.bytes, r.sources) for r in spark.table("windows").collect()] == [(5, 320, 5)]
