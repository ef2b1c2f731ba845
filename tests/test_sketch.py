import hashlib
import ipaddress
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brookwatch.functions import hashing as H
from brookwatch.functions import sketch as S
from brookwatch.service import Aggregator, SketchService

ADDRESSES = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "::", "::1", "1::", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "1::2::3", "12345::", "g::1", ":1:2", "1:2:3:4:5:6:7", "", "abc", None, "01.2.3.4", ":::", "1:::2"]


def raw(text):
    try:
        a = ipaddress.ip_address(text or "")
    except ValueError:
        return None
    return a.packed if a.version == 6 else bytes(10) + b"\xff\xff" + a.packed


def numbered(spark, n):
    return spark.range(1, n + 1).select(H.int_to_ip(F.col("id")).alias("ip"), (F.col("id") % 3).alias("k"))


def test_addresses_and_hashes(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    b = H.ip_bytes(F.col("ip"))
    for r in rows.select("ip", b.alias("b"), H.is_ip(F.col("ip")).alias("ok"), H.sha_hash(b).alias("sha"), H.xx_hash(b).alias("xx")).collect():
        want = raw(r.ip)
        assert (None if r.b is None else bytes(r.b)) == want and r.ok == (want is not None)
        if want:
            assert r.sha == int.from_bytes(hashlib.sha256(want).digest()[:8], "big", signed=True)
            assert r.xx % 2**64 == xxhash.xxh64_intdigest(want)


def fnv(data):
    h = 2166136261
    for x in data:
        h = (h ^ x) * 16777619 % 2**32
    return h


def test_small_hashes(spark):
    r = spark.createDataFrame([("10.1.2.3", "server-a")], "ip string, name string").select(H.fnv1a_ipv4(F.col("ip")), H.fnv1a_text(F.col("ip"), 3), H.name_to_ip(F.col("name"))).first()
    assert (r[0], r[1], r[2]) == (fnv(bytes([10, 1, 2, 3])), fnv(b"\x03\x00" + b"10.1.2.3"), "83.51.112.87")


def test_sparse_codes_keep_the_register(spark):
    rng = np.random.default_rng(7)
    h = [int(x) for x in rng.integers(-(2**63), 2**63, 2000)] + [0, -1, 1, 1 << 39, (1 << 39) - 1, 5 << 50]
    rows = spark.createDataFrame([(x,) for x in h], "h long")
    slot, rank = H.sparse_slot(F.col("h"), 14)
    code = rows.select("h", H.encode_slot(slot, rank, 14).alias("code"))
    back = code.select("h", "code", *[c.alias(n) for c, n in zip(H.decode_slot(F.col("code")), ("slot", "rank"))])
    for r in back.select("*", *[c.alias(n) for c, n in zip(H.dense_of(F.col("slot"), F.col("rank"), 14), ("idx", "rho"))]).collect():
        u = r.h % 2**64
        rest = u & (2**50 - 1)
        assert (r.idx, r.rho) == (u >> 50, 51 - rest.bit_length()) and 0 <= r.code < 2**32


def test_bias_table_is_the_published_one():
    table = S.bias_table()
    # Three of the published rows.
    for at, (estimate, bias) in {0: (11817.361605807972, 11816.361605807972), 100: (13649.056388495068, 9992.056388495068), 235: (81907.69593939184, -12.304060608163127)}.items():
        assert table[at] == pytest.approx((estimate, bias), rel=1e-9)
    assert len(table) == 236 and S.bias_by_position()[0] == pytest.approx(np.mean([b for _, b in table[:6]]))
    assert S.bias_by_position()[236] == pytest.approx(np.mean([b for _, b in table[-6:]])) and S.bias_table(12) == ()


@pytest.mark.parametrize("hash_", ["sha256", "xxhash"])
def test_estimates_in_both_forms(spark, hash_):
    config = S.SketchConfig(hash=hash_)
    for n, form in ((500, "sparse"), (40_000, "dense")):
        slots = S.sparse(numbered(spark, n), [], "ip", config)
        r = S.estimates(slots, [], config).first()
        assert r.form == form and abs(r.estimate - n) <= 0.02 * n
    assert S.to_dense(slots, [], config).exceptAll(S.registers(numbered(spark, n), [], "ip", config)).count() == 0


def test_union_is_idempotent_and_takes_both_forms(spark):
    rows = numbered(spark, 3000)
    slots, dense = S.sparse(rows, [], "ip"), S.registers(rows.filter("k = 0"), [], "ip")
    assert S.union([], slots, slots).exceptAll(slots).count() == 0
    both = S.union([], slots, dense)
    assert both.exceptAll(S.registers(rows, [], "ip")).count() == 0
    with pytest.raises(ValueError):
        S.union([])


def test_wire_forms(spark):
    rho = np.random.default_rng(3).integers(0, 52, 16384)
    data = S.pack_registers(rho)
    assert len(data) == 12288 and (S.unpack_registers(data) == rho).all()
    assert S.pack_registers([63, 0, 0, 1]) == bytes([0b00111111, 0, 0b00000100])
    with pytest.raises(ValueError):
        S.unpack_registers(data[:-1])
    with pytest.raises(ValueError):
        S.pack_registers([64])
    dense = S.registers(numbered(spark, 2000), ["k"], "ip")
    wire = S.export_dense(dense, ["k"])
    assert S.import_dense(wire, ["k"]).exceptAll(dense).count() == 0
    with pytest.raises(Exception, match="dense sketch"):
        S.import_dense(wire.withColumn("p", F.lit(12)), ["k"]).count()
    slots = S.sparse(numbered(spark, 2000), ["k"], "ip")
    assert S.import_sparse(S.export_sparse(slots, ["k"]), ["k"]).exceptAll(slots).count() == 0
    with pytest.raises(Exception, match="sparse sketch"):
        S.import_sparse(S.export_sparse(slots, ["k"]).withColumn("p_prime", F.lit(24)), ["k"]).count()


def test_json_requests(spark):
    wire = S.export_dense(S.registers(numbered(spark, 50), [], "ip"), []).select(F.lit("n1").alias("node_id"), "p", "dense", F.lit(1).alias("anomaly_state"), F.lit("SYN_FLOOD").alias("attack_type"), F.lit(0.5).alias("attack_confidence"))
    bodies = S.merge_request(wire).select("body").unionByName(spark.createDataFrame([("no json",), ('{"node_id":"x","p":14,"registers":"***"}',), ('{"node_id":"x","p":14,"registers":"AAAA"}',)], "body string"))
    out = {r.error: r for r in S.merge_requests(bodies).collect()}
    assert set(out) == {None, "bad JSON", "bad base64", "decode sketch"} and len(out[None].dense) == 12288 and out[None].anomaly_state == 1


def test_variants(spark):
    held = {}
    for i in range(1, 31):
        h = fnv(i.to_bytes(4, "big"))
        held[h >> 28] = max(held.get(h >> 28, 0), 29 - (h & (2**28 - 1)).bit_length())
    raw_ = 0.673 * 256 / (sum(2.0**-r for r in held.values()) + 16 - len(held))
    want = 16 * math.log(16 / (16 - len(held))) if raw_ <= 40 and len(held) < 16 else raw_
    assert S.micro_estimates(S.micro_registers(numbered(spark, 30), [], "ip"), []).first().estimate == math.floor(want + 0.5)
    dense = S.registers(numbered(spark, 30_000), [], "ip")
    assert abs(S.device_estimates(dense, []).first().estimate - 30_000) < 900
    r = S.classic_estimates(dense, []).first()
    zeros = 16384 - dense.count()
    assert r.estimate == math.floor(16384 * math.log(16384 / zeros)) and r.raw <= 40960


def test_config_is_checked():
    for wrong in ({"p": 3}, {"p": 19}, {"p_prime": 14}, {"hash": "md5"}):
        with pytest.raises(ValueError):
            S.SketchConfig(**wrong)
    assert S.SketchConfig(p=4).wire_bytes == 12 and S.DEFAULT.wire_bytes == 12288


def test_service(spark):
    one, two = SketchService(spark), Aggregator(spark)
    rows = numbered(spark, 400).select(F.col("ip").alias("src_ip"))
    bad = one.insert(rows.unionByName(spark.createDataFrame([("nowhere",)], "src_ip string")))
    assert [r.src_ip for r in bad.collect()] == ["nowhere"] and abs(one.estimate() - 400) <= 1 and one.slot_count() == 400
    two.merge(one.get_sketch())
    two.merge(S.export_dense(S.registers(numbered(spark, 500), [], "ip"), []))
    assert abs(two.estimate() - 500) < 12 and two.register(0) >= 0 and two.health()["p"] == 14
    with pytest.raises(NotImplementedError):
        two.insert(rows)
    with pytest.raises(ValueError):
        two.merge(rows)
    assert two.defense_command() == {"activated": False, "global_score": 0.0, "reason": ""}
    two.report(spark.createDataFrame([("a", 100, 0.9, 0.1, 0.2, 1)], "node_id string, ts long, ensemble_score double, loda_score double, hst_score double, anomaly_state int"))
    assert two.defense_command()["activated"]
    assert two.reset_at(115) == 1 and two.estimate() == 0 and not two.defense_command()["activated"]
