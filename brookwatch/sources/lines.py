"""Line-shaped sources, for files and streams alike (a column `value` of text), and readers of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def datagram_packets(lines: DataFrame, least: int = 1) -> DataFrame:
    """Addresses of datagrams that hold some, one a line; a line's length counts as its bytes.  Other columns stay.

    Devices pass over lines shorter than 7 characters (`least`).
    """
    keep = [c for c in lines.columns if c != "value"]
    rows = lines.select(*keep, F.explode(F.split("value", "\n")).alias("src_ip")).withColumn("src_ip", F.trim(F.btrim("src_ip", F.lit(" \t\r"))))
    return rows.filter(F.length("src_ip") >= max(1, least)).withColumn("byte_len", F.length("src_ip").cast("long"))


def serial_packets(lines: DataFrame, prefix: str = "FWD:") -> DataFrame:
    """Addresses that a device forwards on its serial line, `FWD:<ip>`; all other lines are its own talk."""
    keep = [c for c in lines.columns if c != "value"]
    text = F.btrim("value", F.lit(" \t\r\n"))
    rows = lines.filter(F.startswith(text, F.lit(prefix))).select(*keep, F.trim(F.substr(text, F.lit(len(prefix) + 1))).alias("src_ip"))
    return rows.filter("src_ip <> ''").withColumn("byte_len", F.lit(64).cast("long"))


def batches(packets: DataFrame, size: int = 50) -> DataFrame:
    """(node_id, batch, ips) of packets (node_id, seq, src_ip): requests of at most `size` addresses, in order of seq."""
    groups = packets.withColumn("batch", F.floor(F.col("seq") / size)).groupBy("node_id", "batch")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "src_ip")))
    return groups.agg(F.transform(ordered, lambda x: x["src_ip"]).alias("ips"))


def merge_log(lines: DataFrame) -> DataFrame:
    """(at, node, incoming, before, after, sparse, dense, http) of an aggregator's log lines of merges."""
    pattern = r"^(\S+ \S+) \[MERGE\] node=(\S*) incoming=(\d+) before=(\d+) after=(\d+)(.*)$"
    g = [F.regexp_extract("value", pattern, i) for i in range(1, 7)]
    rows = lines.filter(F.col("value").rlike(pattern))
    numbers = [g[i].cast("long").alias(n) for i, n in ((2, "incoming"), (3, "before"), (4, "after"))]
    return rows.select(F.try_to_timestamp(g[0], F.lit("yyyy/MM/dd HH:mm:ss")).alias("at"), g[1].alias("node"), *numbers, F.contains(g[5], F.lit("hasSparse=true")).alias("sparse"), F.contains(g[5], F.lit("hasDense=true")).alias("dense"), F.contains(g[5], F.lit("(HTTP)")).alias("http"))


def error_log(lines: DataFrame) -> DataFrame:
    """(exact, estimate, error_pct) of an accuracy run's log lines; other lines are passed over."""
    pattern = r"(?i)exact\D*(\d+)\D+estimate\D*(\d+)\D+error\D*([0-9.]+)\s*%"
    rows = lines.filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).cast("long").alias("exact"), F.regexp_extract("value", pattern, 2).cast("long").alias("estimate"), F.regexp_extract("value", pattern, 3).cast("double").alias("error_pct"))


def scenario_table(lines: DataFrame) -> DataFrame:
    """(detector, f1, precision, recall) of report lines `name  f1  precision  recall`, numbers in the interval 0 to 1."""
    pattern = r"^\s*([A-Za-z][\w.+-]*)\s+([01]\.\d+)\s+([01]\.\d+)\s+([01]\.\d+)\s*$"
    rows = lines.filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("detector"), *[F.regexp_extract("value", pattern, i).cast("double").alias(n) for i, n in ((2, "f1"), (3, "precision"), (4, "recall"))])


TIMELINE = "window_id int, timestamp long, true_label string, predicted_label string, score double, attack_type_true string, attack_type_pred string, unique_ips long, packet_count long, byte_volume long, latency_ms double"
RESOURCES = "timestamp long, phase string, rss_bytes long, heap_bytes long, stack_bytes long, cpu_percent double, goroutines int, grpc_bytes_tx long, grpc_bytes_rx long"
EXPERIMENT = "experiment_id string, start_time timestamp, end_time timestamp, dataset string, detector string, nodes int, window_duration string, normal_rate int, attack_rate int, scenario string, extra_params map<string,string>"


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TIMELINE)


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RESOURCES)


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIMENT).json(path, multiLine=True)


def read_two_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metric, value) and (window_id, at, count, reason) of a file that holds both, a blank line between them."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n\r?\n")).alias("block", "body"))
    rows = rows.select("block", F.posexplode(F.split("body", r"\r?\n")).alias("line", "value")).filter("line > 0 AND value <> ''")
    cells = F.split("value", ",")
    metrics = rows.filter("block = 0").select(cells[0].alias("metric"), F.try_to_number(cells[1], F.lit("S999999999999999.9999")).cast("double").alias("value"))
    events = rows.filter("block = 1").select(cells[0].cast("long").alias("window_id"), cells[1].alias("at"), cells[2].cast("long").alias("count"), F.get(cells, F.lit(3)).alias("reason"))
    return metrics, events
