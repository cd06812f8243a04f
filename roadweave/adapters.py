"""Driver tables as tracks.

``events`` become detections: a user's events, cut at gaps of more than 12 hours,
are fragments; time is in hours since 2024-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000
SESSION_HOURS = 12.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: frag_id, idx, t, x, y, length, width, conf, direction, gt_id, scenario."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props")
    by_user = Window.partitionBy("user_id").orderBy("t", "event_id")
    base = e.select(
        "event_id",
        "user_id",
        ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / F.lit(3600000000.0)).alias("t"),
        F.col("value").alias("x"),
        (F.lit(12.0) * (F.col("user_id") % 4) + F.lit(0.1) * F.get_json_object("props", "$.k").cast("double")).alias("y"),
    )
    cut = base.withColumn("new", (F.coalesce(F.col("t") - F.lag("t").over(by_user), F.lit(0.0)) > SESSION_HOURS).cast("int"))
    named = cut.withColumn("session", F.sum("new").over(by_user))
    by_fragment = Window.partitionBy("user_id", "session").orderBy("t", "event_id")
    return named.select(
        F.concat_ws("-", "user_id", "session").alias("frag_id"),
        (F.row_number().over(by_fragment) - 1).alias("idx"),
        "t",
        "x",
        "y",
        (F.col("user_id") % 7 + 10).cast("double").alias("length"),
        (F.col("user_id") % 3 + 5).cast("double").alias("width"),
        ((F.col("event_id") * 37 % 100) / 100).alias("conf"),
        F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("direction"),
        F.col("user_id").alias("gt_id"),
        (F.col("user_id") % 3).cast("int").alias("scenario"),
    )


DETECTIONS_SQL = f"""
base AS (SELECT event_id, user_id, (epoch_us(CAST(ts AS TIMESTAMP)) - {EPOCH_US}) / 3600000000.0 AS t, value AS x,
    12.0 * (user_id % 4) + 0.1 * CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events),
cut AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {SESSION_HOURS} THEN 1 ELSE 0 END AS new FROM base),
named AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM cut),
det AS (SELECT user_id || '-' || session AS frag_id,
    CAST(row_number() OVER (PARTITION BY user_id, session ORDER BY t, event_id) - 1 AS INTEGER) AS idx, t, x, y,
    CAST(user_id % 7 + 10 AS DOUBLE) AS length, CAST(user_id % 3 + 5 AS DOUBLE) AS width, (event_id * 37 % 100) / 100.0::DOUBLE AS conf,
    CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS direction, user_id AS gt_id, CAST(user_id % 3 AS INTEGER) AS scenario FROM named)"""


def fragments(det: DataFrame) -> DataFrame:
    """One row per fragment with its samples in order as arrays, and the endpoints."""
    from .operators.prepare import to_fragments, with_endpoints

    return with_endpoints(to_fragments(det))


def endpoints(det: DataFrame) -> DataFrame:
    """The thin table joins work on: no arrays, one map-side combined aggregate."""
    keys = ["frag_id", "direction", "gt_id", "scenario"]
    return det.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.min_by("x", "idx").alias("start_x"),
        F.max_by("x", "idx").alias("end_x"),
        F.min_by("y", "idx").alias("start_y"),
        F.max_by("y", "idx").alias("end_y"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.avg("y").alias("mean_y"),
        F.avg("length").alias("mean_length"),
        F.avg("width").alias("mean_width"),
    )


ENDPOINTS_SQL = (
    DETECTIONS_SQL
    + """,
frag AS (SELECT frag_id, direction, gt_id, scenario, count(*) AS n, min(t) AS first_t, max(t) AS last_t,
    arg_min(x, idx) AS start_x, arg_max(x, idx) AS end_x, arg_min(y, idx) AS start_y, arg_max(y, idx) AS end_y,
    min(x) AS min_x, max(x) AS max_x, avg(y) AS mean_y, avg(length) AS mean_length, avg(width) AS mean_width
  FROM det GROUP BY ALL)"""
)
