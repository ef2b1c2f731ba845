"""What the registered queries share: the events as packets, and the SQL of the same relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwatch.operators import windows as W
from brookwatch.sources.packets import event_packets

HOUR = 3600


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_packets(spark.read.parquet(f"{sf_dir}/events.parquet"))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.traffic(packets(spark, sf_dir))


def seconds(column: str = "window_start") -> Column:
    return F.unix_timestamp(column).alias(column)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.z_scores(traffic(spark, sf_dir), threshold=1.5)


#: p: packets; w: windows; f, r: features; z: z-scores; m: states by a recursion over each node's windows.
P = """WITH RECURSIVE p AS (SELECT event_id, ts, 'node-' || (event_id % 4) AS node_id, '10.' || ((user_id >> 16) & 255) || '.' || ((user_id >> 8) & 255) || '.' || (user_id & 255) AS src_ip,
 '00000000000000000000ffff0a' || printf('%02x%02x%02x', (user_id >> 16) & 255, (user_id >> 8) & 255, user_id & 255) AS ip16, event_type,
 greatest(64, CAST(floor(value * 10) AS BIGINT)) AS byte_len, CASE WHEN event_type = 'error' THEN 'attack' ELSE 'normal' END AS label, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start FROM events WHERE user_id IS NOT NULL),
w AS (SELECT node_id, window_start, count(*) AS packets, CAST(sum(byte_len) AS BIGINT) AS bytes, count(DISTINCT src_ip) AS sources FROM p GROUP BY ALL),
f AS (SELECT *, lag(sources, 1, 0) OVER (PARTITION BY node_id ORDER BY window_start) AS previous, bytes / packets AS bytes_per_packet FROM w),
r AS (SELECT *, CASE WHEN previous = 0 THEN 1.0 ELSE sources / previous END AS ratio FROM f),
h AS (SELECT node_id, window_start, sources, packets, bytes, count(*) OVER o AS n, avg(sources) OVER o AS mean, stddev_pop(sources) OVER o AS sd FROM w WINDOW o AS (PARTITION BY node_id ORDER BY window_start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
z AS (SELECT node_id, window_start, sources, packets, bytes, CASE WHEN n < 5 THEN 0.0 WHEN sd < 1e-9 THEN CASE WHEN sources > mean THEN 5.0 ELSE 0.0 END ELSE (sources - mean) / sd END AS z FROM h)
"""

#: Adds to P the states (threshold 0.4, confirmed by 2, cleared by 3) as m.
STATES = """, o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY window_start) AS i FROM z),
m AS (SELECT node_id, i, window_start, z, packets, bytes, sources, 0 AS state, CASE WHEN z > 0.4 THEN 1 ELSE 0 END AS n FROM o WHERE i = 1
 UNION ALL SELECT o.node_id, o.i, o.window_start, o.z, o.packets, o.bytes, o.sources,
  CASE WHEN m.state = 0 THEN CASE WHEN o.z > 0.4 AND m.n + 1 >= 2 THEN 1 ELSE 0 END WHEN o.z > 0.4 THEN 1 WHEN m.state = 1 THEN 2 WHEN m.n + 1 >= 3 THEN 0 ELSE 2 END,
  CASE WHEN m.state = 0 THEN CASE WHEN o.z > 0.4 AND m.n + 1 < 2 THEN m.n + 1 ELSE 0 END WHEN o.z > 0.4 THEN 0 WHEN m.state = 1 THEN 1 WHEN m.n + 1 >= 3 THEN 0 ELSE m.n + 1 END
  FROM m JOIN o ON o.node_id = m.node_id AND o.i = m.i + 1)
"""
