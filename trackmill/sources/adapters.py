"""The driver's events as observation rows, in Spark and, as common table expressions, in DuckDB's SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01
RADIUS = 10.0
STATUS = {"error": "missing", "signup": "low_confidence", "click": "partially_observed"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    k = lambda n: F.col("event_id") % n == 0
    status = F.lit("observed")
    for kind, name in STATUS.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    x, y = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    z = 0.7 * x + 0.13 * y
    return e.select(
        "event_id",
        F.col("user_id").alias("track_id"),
        (F.col("user_id") % 10).alias("video_id"),
        (F.col("user_id") % 10 % 3).alias("session_id"),
        "ts",
        ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1e6).alias("t_s"),
        x.alias("x"),
        y.alias("y"),
        F.lit(RADIUS).alias("radius"),
        (z - 2 * math.pi * F.floor((z + math.pi) / (2 * math.pi))).alias("theta"),
        status.alias("status"),
        F.when(k(23), "tracking_prediction").when(k(17), "manual_corrected").otherwise("observation").alias("source"),
        F.when(k(29), "ambiguous").otherwise("temporal_association").alias("identity_status"),
        k(31).alias("assignment_ambiguous"),
        F.when(k(37), False).when(k(5), None).otherwise(True).alias("observable"),
        F.when(k(41), "floor_boundary").otherwise("inside_floor").alias("surface_status"),
        F.when(F.col("event_type") == "purchase", "blurred_edge_review").alias("measurement_warning"),
    )


def obs_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are a track's rows in time order."""
    order = Window.partitionBy("track_id").orderBy("ts")
    return _observations(spark, sf_dir).withColumn("frame_index", (F.row_number().over(order) - 1).cast("long"))


def obs_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are hours; of a track's rows in one hour the last event stays."""
    o = _observations(spark, sf_dir).withColumn("frame_index", F.floor(F.col("t_s") / 3600))
    last = Window.partitionBy("video_id", "frame_index", "track_id").orderBy(F.desc("event_id"))
    return o.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analysts' submissions: a customer is a recording, its hundreds a parent recording."""
    o = orders(spark, sf_dir)
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return o.select(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderkey") % 53 != 0, F.col("o_orderkey") % 4).alias("analyst_id"),
        F.col("o_custkey").alias("source"),
        F.when(F.col("o_orderkey") % 47 != 0, F.col("o_custkey") % 12).alias("session_id"),
        F.when(F.col("o_orderstatus") == "O", "train").when(F.col("o_orderstatus") == "F", "test").alias("role"),
        F.col("o_orderpriority").alias("settings"),
        (F.col("o_orderkey") % 3).alias("review"),
        (F.col("o_orderkey") % 2).alias("code"),
        F.when(F.col("o_orderkey") % 61 != 0, F.concat(F.lit("run"), "o_orderkey")).alias("run"),
        F.when(F.col("o_orderkey") % 59 == 0, "failed").otherwise("complete").alias("run_status"),
        F.when(F.col("o_orderkey") % 43 == 0, "old").otherwise("now").alias("recorded_key"),
        F.lit("now").alias("current_key"),
        (F.col("o_orderkey") % 71 == 0).alias("excluded"),
        (F.col("o_custkey") % 100).alias("parent"),
        F.when(F.col("o_orderkey") % 67 != 0, day).alias("parent_from"),
        (day + 1 + F.col("o_orderkey") % 5).alias("parent_to"),
    )


VIEWS = {
    "obs_all": """
SELECT event_id, user_id AS track_id, user_id % 10 AS video_id, user_id % 10 % 3 AS session_id, ts,
       (epoch_us(ts) - 1704067200000000) / 1e6 AS t_s, value AS x, json_extract_string(props, '$.k')::DOUBLE AS y, 10.0::DOUBLE AS radius,
       z - 2 * pi() * floor((z + pi()) / (2 * pi())) AS theta,
       CASE event_type WHEN 'error' THEN 'missing' WHEN 'signup' THEN 'low_confidence' WHEN 'click' THEN 'partially_observed' ELSE 'observed' END AS status,
       CASE WHEN event_id % 23 = 0 THEN 'tracking_prediction' WHEN event_id % 17 = 0 THEN 'manual_corrected' ELSE 'observation' END AS source,
       CASE WHEN event_id % 29 = 0 THEN 'ambiguous' ELSE 'temporal_association' END AS identity_status,
       event_id % 31 = 0 AS assignment_ambiguous,
       CASE WHEN event_id % 37 = 0 THEN false WHEN event_id % 5 = 0 THEN NULL ELSE true END AS observable,
       CASE WHEN event_id % 41 = 0 THEN 'floor_boundary' ELSE 'inside_floor' END AS surface_status,
       CASE WHEN event_type = 'purchase' THEN 'blurred_edge_review' END AS measurement_warning
FROM (SELECT *, 0.7 * value + 0.13 * json_extract_string(props, '$.k')::DOUBLE AS z FROM events)""",
    "obs_seq": "SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts) - 1 AS frame_index FROM obs_all",
    "obs_hour": """
SELECT * EXCLUDE (n) FROM (SELECT *, floor(t_s / 3600)::BIGINT AS frame_index,
       row_number() OVER (PARTITION BY user_video, floor(t_s / 3600), track_id ORDER BY event_id DESC) AS n
FROM (SELECT *, video_id AS user_video FROM obs_all)) WHERE n = 1""",
    "submissions": """
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 53 <> 0 THEN o_orderkey % 4 END AS analyst_id, o_custkey AS source,
       CASE WHEN o_orderkey % 47 <> 0 THEN o_custkey % 12 END AS session_id,
       CASE o_orderstatus WHEN 'O' THEN 'train' WHEN 'F' THEN 'test' END AS role, o_orderpriority AS settings, o_orderkey % 3 AS review,
       o_orderkey % 2 AS code, CASE WHEN o_orderkey % 61 <> 0 THEN 'run' || o_orderkey END AS run,
       CASE WHEN o_orderkey % 59 = 0 THEN 'failed' ELSE 'complete' END AS run_status,
       CASE WHEN o_orderkey % 43 = 0 THEN 'old' ELSE 'now' END AS recorded_key, 'now' AS current_key, o_orderkey % 71 = 0 AS excluded,
       o_custkey % 100 AS parent,
       CASE WHEN o_orderkey % 67 <> 0 THEN date_diff('day', DATE '1995-01-01', o_orderdate::DATE) END AS parent_from,
       date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + 1 + o_orderkey % 5 AS parent_to
FROM orders""",
}
USABLE = """(status NOT IN ('missing', 'predicted_only', 'outside_interval') AND source NOT IN ('tracking_prediction', 'physics_prediction')
 AND NOT assignment_ambiguous AND identity_status <> 'ambiguous' AND coalesce(observable, true) AND surface_status <> 'floor_boundary')"""


def sql(body: str, *views: str) -> str:
    """A query with the named views before it; `body` may begin with more of them after a comma."""
    needed = [v for v in VIEWS if v in views or (v == "obs_all" and {"obs_seq", "obs_hour"} & set(views))]
    head = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed)
    body = body.strip()
    return f"WITH {head}{',' if body.startswith(',') else ''}\n{body.lstrip(',')}".replace("{usable}", USABLE)
