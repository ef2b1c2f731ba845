import datetime as dt

import pytest
from pyspark.sql import functions as F

from brookwatch import sinks
from brookwatch.operators import aggregator, evaluate, metrics
from brookwatch.operators import windows as W
from brookwatch.operators.detectors import DETECTORS, detector
from brookwatch.sources import datasets, generators, lines
from brookwatch.sources.packets import header_packets, injected

REPORT = "node_id string, ts long, ensemble_score double, loda_score double, hst_score double, anomaly_state int"


def test_correlation_stale_grace_and_edges(spark):
    rows = [("a", 5, 0.9, 0.1, 0.2, 1), ("b", 7, 0.2, 0.3, 0.1, 0), ("b", 12, 0.3, 0.0, 0.0, 0), ("c", 8, 0.1, 0.0, 0.0, 0), ("", 9, 9.0, 9.0, 9.0, 1), ("a", 61, 0.9, 0.0, 0.0, 1)]
    out = aggregator.correlated(spark.createDataFrame(rows, REPORT), 10)
    got = {r.tick: (r.total, r.under_attack, r.max_score, r.activated) for r in out.collect()}
    assert got == {10: (3, 1, 0.9, False), 20: (3, 1, 0.9, False), 30: (1, 0, 0.3, False), 70: (1, 1, 0.9, True), 80: (1, 1, 0.9, True)}
    assert {(r.tick, r.action) for r in aggregator.defense_edges(out, 10).collect()} == {(70, "lockdown"), (90, "unlock")}
    reset = aggregator.correlated(spark.createDataFrame(rows, REPORT), 10, [60])
    assert not reset.filter("activated").count() and reset.filter("in_grace").count() == 2
    last = aggregator.node_latest(spark.createDataFrame(rows, REPORT))
    assert {(r.node_id, r.ts) for r in last.collect()} == {("a", 61), ("b", 12), ("c", 8)}
    fresh = aggregator.node_latest(spark.createDataFrame(rows, REPORT), F.lit(70), 20)
    assert [r.node_id for r in fresh.collect()] == ["a"]
    state = spark.createDataFrame([("x", 75, 0), ("x", 85, 2), ("x", 95, 0)], "node_id string, ts long, state int")
    assert [r.escalated for r in aggregator.escalated(state, out, 10).orderBy("ts").collect()] == [1, 2, 0]
    assert aggregator.correlated(spark.createDataFrame([], REPORT), 10).count() == 0


def test_ground_truth_ties_and_gaps(spark):
    rows = spark.createDataFrame([(0, "Syn", "B"), (0, "Syn", "A"), (0, "normal", ""), (3, "BENIGN", ""), (3, "Odd", "")], "window_id long, label string, attack_type string")
    got = [(r.window_id, r.is_attack, r.attack_count, r.normal_count, r.primary_attack_type) for r in evaluate.ground_truth(rows, 2).orderBy("window_id").collect()]
    assert got == [(0, 1, 2, 1, "A"), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 1, 1, 1, "Odd")]
    assert evaluate.ground_truth(rows.limit(0), 2).count() == 0


def test_events_against_truth(spark):
    alerts = spark.createDataFrame([(4, 9.5), (4, 9.0), (6, 13.0), (9, 19.0)], "window_id long, at double")
    attacks = spark.createDataFrame([(4,), (5,), (6,), (7,)], "window_id long")
    total = spark.createDataFrame([(12,)], "total long")
    r = evaluate.event_confusion(alerts, attacks, total).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.recall, round(r.precision, 3)) == (2, 1, 2, 7, 0.5, 0.667)
    assert {x.window_id for x in evaluate.missed_windows(alerts, attacks).collect()} == {5, 7}
    assert evaluate.time_to_detect(alerts, attacks, F.lit(0.0), 2.0).first()[0] == 1.0
    assert evaluate.time_to_detect(alerts, attacks, F.lit(5.0), 2.0).first()[0] == 0.0
    assert evaluate.time_to_detect(alerts.limit(0), attacks, F.lit(0.0), 2.0).first()[0] is None


def test_timeline_summary_without_rows(spark):
    r = evaluate.timeline_summary(spark.createDataFrame([], lines.TIMELINE), spark.createDataFrame([], lines.RESOURCES)).first()
    assert (r.tp, r.precision, r.recall, r.f1_score, r.detection_latency_ms, r.peak_rss_bytes, r.total_windows) == (0, 0.0, 0.0, 0.0, 0.0, 0, 0)


def test_histogram_quantile(spark):
    rows = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 30), ("a", 4.0, 30), ("a", float("inf"), 40), ("b", 1.0, 0), ("b", float("inf"), 0)], "k string, le double, count long")
    assert {q: [r.quantile for r in metrics.histogram_quantile(rows, ["k"], q).collect()] for q in (0.125, 0.5, 0.9)} == {0.125: [0.5], 0.5: [1.5], 0.9: [4.0]}


def test_as_of_crosses_buckets_and_ties(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 20, 2), ("a", 1, 3), ("b", 7, 4)], "k string, ts long, own int")
    right = spark.createDataFrame([("a", 3, 1.0), ("a", 5, 2.0), ("a", 5, 3.0), ("a", 6, None), ("b", 8, 9.0)], "k string, ts long, v double")
    for bucket in (1, 4, 100):
        assert {(r.own, r.v) for r in metrics.as_of(left, right, "v", bucket, ["k"]).collect()} == {(1, 3.0), (2, 3.0), (3, None), (4, None)}


def test_intervals_and_phases(spark):
    rows = spark.createDataFrame([("n", t, "x" if t in (1, 2, 5) else "y") for t in range(7)], "k string, ts long, phase string")
    assert [(r.phase, r.first_ts, r.last_ts) for r in metrics.intervals(rows, ["k"], "phase").orderBy("first_ts").collect()] == [("y", 0, 0), ("x", 1, 2), ("y", 3, 4), ("x", 5, 5), ("y", 6, 6)]
    p = metrics.relative_time(rows, ["k"]).withColumn("p", metrics.phase_of(F.col("elapsed"), [("a", 2), ("b", 4)], "c"))
    assert [r.p for r in p.orderBy("ts").collect()] == list("aabbccc")


def test_features_and_classes(spark):
    f = spark.createDataFrame([(1000, 500, 2000, 100000, 2.0, 50.0, 0.5, 2.0)], "sources long, previous long, packets long, bytes long, ratio double, bytes_per_packet double, residual double, z double")
    assert W.vector(f, populate=True).first().vector == [1000, 500, 2.0, 2000, 100000, 50, 0.5, 2] and W.vector(f).first().vector[6:] == [0, 0]
    rows = spark.createDataFrame([(60, 10, 600, 60 * 600, 100.0), (60, 10, 600, 300 * 600, 100.0), (30, 10, 400, 900 * 400, 100.0), (30, 10, 100, 70 * 100, 100.0), (10, 10, 100, 100, 100.0), (10, 0, 0, 0, 0.0), (150, 10, 100, 90000, 100.0)], "sources long, previous long, packets long, bytes long, baseline_packets double")
    got = [(r.attack_type, round(r.confidence, 2)) for r in W.classify(W.attack_features(rows)).collect()]
    assert got == [("SYN_FLOOD", 1.0), ("UDP_FLOOD", 1.0), ("HTTP_FLOOD", 1.0), ("PORT_SCAN", 1.0), ("NONE", 0.0), ("NONE", 0.0), ("SYN_FLOOD", 0.33)]


def test_ticks_grow_within_a_window(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("n", at + dt.timedelta(minutes=m), s, 10) for m, s in ((0, "a"), (1, "b"), (11, "a"), (12, "c"), (61, "a"))], "node_id string, ts timestamp, src_ip string, byte_len long")
    assert [(r.packets, r.bytes, r.sources) for r in W.ticks(rows).orderBy("tick").collect()] == [(2, 20, 2), (4, 40, 3), (1, 10, 1)]


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_detectors_share_one_form(spark, name):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("n", at + dt.timedelta(hours=h), 100 if h < 29 else 50_000, 100, 1.0, 200, 2000, 10.0) for h in range(30)], "node_id string, window_start timestamp, sources long, previous long, ratio double, packets long, bytes long, bytes_per_packet double")
    d = detector(name)
    out = d.scored(W.vector(rows))
    assert {"score", "baseline", "trained", "alert"} <= set(out.columns) and out.count() == 30
    alerts = [r.window_start.hour for r in d.alerts(W.vector(rows)).collect()]
    assert alerts == ([] if name in ("loda", "hst", "ensemble") else [5]) and (name in ("loda", "hst", "ensemble") or out.filter("alert").count() == 1)
    with pytest.raises(ValueError):
        detector("unknown")


def test_line_sources(spark):
    text = spark.createDataFrame([("1.1.1.1\n 2.2.2.2\r\n\nx",), ("",)], "value string")
    assert sorted((r.src_ip, r.byte_len) for r in lines.datagram_packets(text).collect()) == [("1.1.1.1", 7), ("2.2.2.2", 7), ("x", 1)]
    assert lines.datagram_packets(text, 7).count() == 2
    serial = spark.createDataFrame([("FWD: 1.1.1.1 \r",), ("STATUS",), ("FWD:",)], "value string")
    assert [r.src_ip for r in lines.serial_packets(serial).collect()] == ["1.1.1.1"]
    log = spark.createDataFrame([("2024/01/02 03:04:05 [MERGE] node=a incoming=1 before=2 after=3 hasSparse=true hasDense=false",), ("2024/01/02 03:04:05 [MERGE] node=b incoming=1 before=2 after=3 (HTTP)",), ("other",)], "value string")
    assert [(r.node, r.after, r.sparse, r.http) for r in lines.merge_log(log).orderBy("node").collect()] == [("a", 3, True, False), ("b", 3, False, True)]
    table = spark.createDataFrame([("  ensemble  0.91 0.90 0.92 ",), ("---",)], "value string")
    assert [tuple(r) for r in lines.scenario_table(table).collect()] == [("ensemble", 0.91, 0.90, 0.92)]
    acc = spark.createDataFrame([("exact=100 estimate=98 error=2.00%",)], "value string")
    assert tuple(lines.error_log(acc).first()) == (100, 98, 2.0)


def test_headers_and_injection(spark):
    rows = spark.createDataFrame([(1, "n", "TCP", "1.1.1.1", None, 9), (1, "n", "udp", "", "::1", 9), (1, "n", "icmp", "1.1.1.1", None, 9), (1, "n", "tcp", None, None, 9)], "ts long, node_id string, protocol string, v4_src string, v6_src string, byte_len long")
    assert [r.src_ip for r in header_packets(rows).collect()] == ["1.1.1.1", "::1"]
    asked = spark.createDataFrame([(1, "n", ["1.1.1.1", "", "2.2.2.2"], 0)], "ts long, node_id string, ips array<string>, byte_len long")
    assert [(r.src_ip, r.byte_len) for r in injected(asked).collect()] == [("1.1.1.1", 64), ("2.2.2.2", 64)]


def test_data_sets_from_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.csv").write_text(" Timestamp, Source IP, Label, Total Length of Fwd Packets\n2024-01-01 00:00:00, 1.1.1.1 ,Syn,5\n,2.2.2.2,BENIGN,\n")
    (tmp_path / "standardized.csv").write_text(" Timestamp, Source IP, Label, Total Length of Fwd Packets\n,9.9.9.9,Syn,5\n")
    rows = datasets.cicddos2019(datasets.raw_rows(spark, str(tmp_path))).orderBy("src_ip").collect()
    assert [tuple(r) for r in rows] == [("2024-01-01 00:00:00", "1.1.1.1", "attack", "SYN_FLOOD", "5"), ("", "2.2.2.2", "normal", "", "")]


def test_generators(spark):
    numbers = [0, 254, 255, 300, 70_000, 20_000_000]
    want = [".".join(str(x) for x in (i // 16581375 % 256, i // 65025 % 256, i // 255 % 256, i % 255)) for i in numbers]
    assert [r.ip for r in spark.createDataFrame([(i,) for i in numbers], "i long").select(generators.numbered_ip(F.col("i")).alias("ip")).collect()] == want
    a = generators.scenario(spark, 3, 5, 20, (1,), seed=1)
    assert a.count() == 35 and a.exceptAll(generators.scenario(spark, 3, 5, 20, (1,), seed=1)).count() == 0
    assert a.filter("label = 'attack'").select("window_id").distinct().count() == 1
    pool = generators.device_traffic(spark, "normal", pool=10)
    assert pool.select("src_ip").distinct().count() <= 10 and pool.filter("src_ip NOT LIKE '10.%' OR src_ip LIKE '%.0' OR byte_len <> 64").count() == 0
    with pytest.raises(ValueError):
        generators.device_traffic(spark, "other")
    extra = generators.with_attacks(spark.createDataFrame([(0, "1.1.1.1")], "w int, src_ip string"), "w", [0, 2], 3)
    assert extra.groupBy("w").count().orderBy("w").collect()[1]["count"] == 3


def test_sinks(spark, tmp_path):
    timeline = spark.createDataFrame([(1, 2, "attack", "attack", 0.123456, "A", "A", 1, 2, 3, 1.005)], lines.TIMELINE)
    resources = spark.createDataFrame([(1, "normal", 5, 1, 1, 12.3456, 1, 0, 0)], lines.RESOURCES)
    config = spark.createDataFrame([("e1", None, None, "d", "ensemble", 1, "2s", 1, 2, "s", {"a": "b"})], lines.EXPERIMENT)
    sinks.write_experiment(str(tmp_path / "e"), config, timeline, resources, evaluate.timeline_summary(timeline, resources))
    assert lines.read_timeline(spark, str(tmp_path / "e/timeline.csv")).first().score == 0.1235
    assert lines.read_resources(spark, str(tmp_path / "e/metrics.csv")).first().cpu_percent == 12.35
    assert lines.read_experiment(spark, str(tmp_path / "e/config.json")).first().extra_params == {"a": "b"}
    (tmp_path / "two.csv").write_text("metric,value\nrecall,0.5000\ntrue_positives,2\n\nwindow_id,at,count,reason\n4,2024-01-01T00:00:00Z,9,eval_detected\n")
    found, events = lines.read_two_blocks(spark, str(tmp_path / "two.csv"))
    assert {r.metric: r.value for r in found.collect()} == {"recall": 0.5, "true_positives": 2.0} and tuple(events.first()) == (4, "2024-01-01T00:00:00Z", 9, "eval_detected")
    one = spark.createDataFrame([(2, 1, 2, 0.5)], "tp long, fp long, fn long, recall double")
    sinks.write_evaluation(str(tmp_path / "v"), one, spark.createDataFrame([(7,)], "time_to_detect_ns long"), events)
    assert {r.metric: r.value for r in spark.read.csv(str(tmp_path / "v/metrics"), header=True).collect()}["recall"] == "0.5000"
    rows, seen = sinks.observed(spark.createDataFrame([(1, 2), (3, 4)], "packets long, bytes long"))
    rows.collect()
    assert seen.get == {"rows": 2, "packets": 4, "bytes": 6}


def test_streams_equal_batches(spark, tmp_path):
    from brookwatch.functions import sketch
    from brookwatch.operators import online
    from brookwatch.streaming import windows as streams

    at = dt.datetime(2024, 1, 1)
    scores = spark.createDataFrame([("n", at + dt.timedelta(hours=h), 0.9 if 3 < h < 9 else 0.1) for h in range(20)], "node_id string, window_start timestamp, score double")
    scores.write.parquet(str(tmp_path / "scores"))
    stream = streams.state_stream(spark.readStream.schema(scores.schema).parquet(str(tmp_path / "scores")))
    stream.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(90)
    assert [r.state for r in spark.table("states").orderBy("window_start").collect()] == [r.state for r in online.states(scores).orderBy("window_start").collect()]
    packets = spark.createDataFrame([("n", at, f"1.1.1.{i % 20}", 64) for i in range(60)], "node_id string, ts timestamp, src_ip string, byte_len long")
    packets.repartition(3).write.parquet(str(tmp_path / "packets"))
    source = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "packets"))
    streams.shipped(source, str(tmp_path / "out"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(90)
    shipped = sketch.merge(spark.read.parquet(str(tmp_path / "out")).drop("batch"), ["node_id"])
    assert shipped.exceptAll(sketch.sparse(packets, ["node_id"], "src_ip")).count() == 0 and shipped.count() == 20
    streams.each_batch(source, sinks.replay_batches(str(tmp_path / "sent"), 25), str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination(90)
    sent = spark.read.text(str(tmp_path / "sent")).select(F.size(F.from_json("value", "node_id string, ips array<string>")["ips"]).alias("n"))
    assert sent.agg(F.sum("n")).first()[0] == 60 and sent.agg(F.max("n")).first()[0] <= 25
