import datetime as dt

import numpy as np

from brookwatch.operators import online, reports


def test_ewma_warms_up_and_alerts():
    e = online.Ewma()
    assert [e.step(x)[2] for x in [100] * 6 + [1000]] == [False] * 6 + [True]
    zero = online.Ewma()
    assert not any(zero.step(x)[2] for x in [0] * 6 + [5])


def test_detectors_score_after_training():
    rng = np.random.default_rng(1)
    loda, trees = online.Loda(), online.HalfSpaceTrees(normalise=True)
    assert loda.score(np.ones(8)) == trees.score(np.ones(8)) == 0
    for x in rng.normal(size=(50, 8)):
        loda.update(x)
        trees.update(x)
    assert loda.trained and trees.trained and loda.score(np.full(8, 30.0)) > loda.score(np.zeros(8))
    assert (trees.reference[:, 0] == 50).all() and 0 < trees.score(np.zeros(8)) <= 63


def test_ensemble_rises_in_an_attack():
    e = online.Ensemble()
    rng = np.random.default_rng(2)
    calm = [e.step(s, s, np.array([s, s, 1, s, s, 64, 0, 0.0]))[4] for s in 100 + rng.integers(-5, 5, 30).astype(float)]
    high = [e.step(5000, 5000, np.array([5000, 5000, 1, 9e4, 9e5, 10, 0, 0.0]))[4] for _ in range(3)]
    assert all(0 <= s <= 1 for s in calm + high) and max(high) > max(calm[10:])


def test_rate_limit_and_hash():
    assert online.fnv1a(["a", "", "1.2.3.4"], 1).tolist() == [_fnv(b"\x01\x00" + t) for t in (b"a", b"", b"1.2.3.4")]
    limit, one = online.RateLimit(rate=2, per_source=3), np.zeros(4, int)
    assert [limit.step(0.0, one)[0] for _ in range(3)] == [True, True, False]
    assert [limit.step(10.0, one) for _ in range(3)] == [(True, 1), (True, 2), (True, 3)] and limit.step(10.0, one) == (False, 4)


def test_gate_follows_the_state():
    gate, one = online.Gate(rate=1, per_source=2), np.zeros(4, int)
    assert [gate.step(0.0, 0, one) for _ in range(5)] == [(True, False, 0)] * 5
    assert [gate.step(1.0, 1, one)[:2] for _ in range(2)] == [(True, True), (False, True)]
    assert gate.step(2.0, 2, one)[1:] == (True, 1) and gate.limit.dropped == 1
    assert gate.step(3.0, 0, one) == (True, False, 1) and gate.limit.tokens == 2 and not gate.limit.counts.any()
    reset = online.RateLimit(rate=10, per_source=5)
    assert sum(reset.step(0.0, one)[0] for _ in range(20)) == 5


def test_counts_decay_by_halves():
    limit, one = online.RateLimit(rate=1000, per_source=5), np.zeros(4, int)
    assert [limit.step(0.0, one)[1] for _ in range(8)] == list(range(1, 9))
    assert limit.step(5.0, one) == (True, 5) and limit.step(10.0, one) == (True, 3)


def test_device_detector():
    d = online.DeviceDetector()
    assert [d.step(100) for _ in range(9)] == [0.0] * 9
    assert d.step(1000) == 0.5 * 1 + 0.5 * np.float32(4 / 6)
    calm = online.DeviceDetector()
    assert max(calm.step(x) for x in (100, 105, 95, 102, 98, 101, 99, 103)) == 0


def test_baseline_stops_in_an_attack_and_after_enough():
    b = online.Baseline(most=3)
    assert b.step(10, 1000, 0) == (10, 100) and b.step(99, 99, 1) == (10, 100)
    assert b.step(20, 400, 0) == (15, 60) and b.step(0, 0, 0) == (10, 60) and b.step(1000, 1, 0) == (10, 60)


def _fnv(data):
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % (1 << 32)
    return h


def test_fold_restarts_each_key_and_streams(spark, tmp_path):
    rows = [(n, dt.datetime(2024, 1, 1, h), 10 if h < 7 else 100) for n in ("a", "b") for h in range(8)]
    windows = spark.createDataFrame(rows, "node_id string, window_start timestamp, sources long")
    got = online.ewma_alerts(windows).orderBy("node_id", "window_start").collect()
    assert [r.alert for r in got] == ([False] * 7 + [True]) * 2 and got[8].ewma == 10
    assert online.ewma_alerts(windows.limit(0)).count() == 0
    windows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(windows.schema).parquet(str(tmp_path / "in"))
    out = online.fold_stream(stream, "node_id", "window_start", online.Ewma, online._ewma, "baseline double, ewma double, alert boolean")
    run = out.writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    assert [(r.node_id, r.ewma) for r in spark.table("folded").orderBy("node_id", "window_start").collect()] == [(r.node_id, r.ewma) for r in got]


def test_summary_and_rate(spark):
    rows = spark.createDataFrame([(True, True, 2.0), (True, False, 0.0), (False, True, 0.0), (False, False, 0.0)], "truth boolean, alert boolean, latency double")
    r = reports.summary(rows).first()
    assert (r.precision, r.recall, r.f1, r.fpr, r.fnr, r.mean_latency) == (0.5, 0.5, 0.5, 0.5, 0.5, 2.0)
    c = spark.createDataFrame([("n", 0, 10), ("n", 30, 40), ("n", 60, 5), ("n", 120, 65)], "node_id string, seconds long, c long")
    assert [x.rate for x in reports.resets_rate(c, "c").orderBy("seconds").collect()] == [0.0, 0.5, 0.5, 1.0]
