"""Packet sources: relations (ts, node_id, src_ip, byte_len, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwatch.functions.hashing import int_to_ip, is_ip, name_to_ip

DEFAULT_LENGTH = 64
#: Columns of a standardised data set, in order.
STANDARD = ("timestamp", "src_ip", "label", "attack_type", "byte_len")


def event_packets(events: DataFrame) -> DataFrame:
    """The events table as packets; rows without a source are dropped."""
    out = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("node-"), (F.col("event_id") % 4).cast("string")).alias("node_id"),
        int_to_ip(F.col("user_id") + F.lit(10 << 24).cast("long")).alias("src_ip"),
        F.greatest(F.lit(DEFAULT_LENGTH).cast("long"), F.floor(F.col("value") * 10).cast("long")).alias("byte_len"),
        F.when(F.col("event_type") == "error", "attack").otherwise("normal").alias("label"),
    )
    return out.filter("src_ip IS NOT NULL AND src_ip <> ''")


def header_packets(headers: DataFrame) -> DataFrame:
    """Decoded packet headers (ts, node_id, protocol, v4_src, v6_src, byte_len): TCP and UDP with an address of either kind."""
    src = F.coalesce(F.nullif("v4_src", F.lit("")), F.nullif("v6_src", F.lit("")))
    return headers.filter(F.lower("protocol").isin("tcp", "udp")).select("ts", "node_id", src.alias("src_ip"), "byte_len").filter("src_ip IS NOT NULL")


def parsed(rows: DataFrame, ts_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Packets of text columns STANDARD: times may also be epoch seconds; lengths that are 0 or no number are 64; a source that
    is no address and has no dot becomes a fixed one made from its name; rows without a source are dropped."""
    when = F.coalesce(F.try_to_timestamp(F.trim("timestamp"), F.lit(ts_format)), F.timestamp_seconds(F.expr("try_cast(trim(timestamp) AS DOUBLE)")))
    size = F.coalesce(F.nullif(F.expr("try_cast(trim(byte_len) AS BIGINT)"), F.lit(0)), F.lit(DEFAULT_LENGTH))
    src = F.trim("src_ip")
    named = ~is_ip(src) & (src != "") & ~F.contains(src, F.lit("."))
    out = rows.select(when.alias("ts"), F.when(named, name_to_ip(src)).otherwise(src).alias("src_ip"), F.trim("label").alias("label"), F.trim("attack_type").alias("attack_type"), F.greatest(size, F.lit(1)).cast("long").alias("byte_len"))
    return out.filter("src_ip <> ''")


def csv_packets(spark: SparkSession, path: str | list[str], ts_format: str = "yyyy-MM-dd HH:mm:ss", columns: dict[str, int] | None = None, header: bool = True, max_rows: int | None = None) -> DataFrame:
    """A labelled CSV, or a folder of them.  `columns` gives the places of STANDARD's columns (missing ones are empty);
    max_rows is the reader's limit on the rows taken."""
    places = columns if columns is not None else {c: i for i, c in enumerate(STANDARD)}
    width = max(places.values()) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.csv(path, header=header, schema=schema, enforceSchema=True, recursiveFileLookup=True)
    rows = rows.select(*[(F.col(f"c{places[c]}") if c in places else F.lit("")).alias(c) for c in STANDARD])
    rows = rows.na.fill("", list(STANDARD))
    return parsed(rows if max_rows is None else rows.limit(max_rows), ts_format)


def injected(ips: DataFrame) -> DataFrame:
    """Packets of injection requests (ts, node_id, ips array<string>, byte_len): an address each, 64 bytes unless given."""
    size = F.coalesce(F.nullif("byte_len", F.lit(0)), F.lit(DEFAULT_LENGTH)).cast("long")
    return ips.select("ts", "node_id", F.explode("ips").alias("src_ip"), size.alias("byte_len")).filter("src_ip <> ''")


def quarantined(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets with an address, packets without one): bad rows are set aside and never end a job."""
    good = is_ip(F.col("src_ip"))
    return packets.filter(good), packets.filter(~good)


def is_attack(label: Column) -> Column:
    return F.coalesce((label != "") & ~F.lower(label).isin("benign", "normal", "0"), F.lit(False))
