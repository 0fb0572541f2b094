"""Domain views over the driver's tables, in DataFrame form and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("station_id", F.col("user_id") % 15).withColumnRenamed("ts", "t")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of 15 stations."""
    return events(spark, sf_dir).select("station_id", "t", "event_id", F.least(F.col("value") / 250.0, F.lit(1.0)).alias("s4"), F.get_json_object("props", "$.k").cast("double").alias("tec"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs in hourly bins, with nulls where a station was silent."""
    return clean.resample(obs(spark, sf_dir), "t", "1 hour", {"s4": "max", "tec": "mean"}, ["station_id"])


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'click'").select("station_id", "t", "event_id", (20 - F.col("value") / 2).alias("bz"), (300 + F.col("value")).alias("v_sw"), (1 + F.col("value") / 50).alias("n_p"))


def geomag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'view'").select("station_id", "t", "event_id", (-F.col("value")).alias("dst"))


def aurora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'purchase'").select("station_id", "t", "event_id", F.col("value").alias("hp_north"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(n.alias("id"), (-20 + (n * 17) % 41).cast("double").alias("lat"), (-30 + (n * 29) % 91).cast("double").alias("lon"), F.col("n_name").alias("country"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean content by cell (lat, lon) and epoch."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("lat"), F.col("l_linenumber").cast("long").alias("lon"), F.col("l_shipdate").alias("epoch")).agg(F.avg("l_quantity").alias("tec"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.col("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", truth.alias("y_true"), (truth + (F.col("l_discount") - 0.05)).alias("y_pred"))


OBS = "obs AS (SELECT CAST(user_id % 15 AS BIGINT) AS station_id, ts AS t, event_id, least(value / 250.0, 1.0) AS s4, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS tec FROM events)"
GRID = (
    OBS + ", bins AS (SELECT station_id, time_bucket(INTERVAL '1 hour', t) AS t, max(s4) AS s4, avg(tec) AS tec FROM obs GROUP BY 1, 2), span AS (SELECT station_id, min(t) AS lo, max(t) AS hi FROM bins GROUP BY 1),"
    " steps AS (SELECT station_id, unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS t FROM span), grid AS (SELECT s.station_id, s.t, b.s4, b.tec FROM steps s LEFT JOIN bins b ON b.station_id = s.station_id AND b.t = s.t)"
)
WIND = "wind AS (SELECT CAST(user_id % 15 AS BIGINT) AS station_id, ts AS t, event_id, 20 - value / 2 AS bz, 300 + value AS v_sw, 1 + value / 50 AS n_p FROM events WHERE event_type = 'click')"
GEO = "geo AS (SELECT CAST(user_id % 15 AS BIGINT) AS station_id, ts AS t, event_id, -value AS dst FROM events WHERE event_type = 'view')"
AURORA = "aur AS (SELECT CAST(user_id % 15 AS BIGINT) AS station_id, ts AS t, event_id, value AS hp_north FROM events WHERE event_type = 'purchase')"
STATIONS = "stations AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(-20 + (n_nationkey * 17) % 41 AS DOUBLE) AS lat, CAST(-30 + (n_nationkey * 29) % 91 AS DOUBLE) AS lon, n_name AS country FROM nation)"
MAPS = "maps AS (SELECT l_suppkey AS lat, CAST(l_linenumber AS BIGINT) AS lon, l_shipdate AS epoch, avg(l_quantity) AS tec FROM lineitem GROUP BY 1, 2, 3)"
PAIRS = "pairs AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS y_true, l_quantity / 50 + (l_discount - 0.05) AS y_pred FROM lineitem)"
