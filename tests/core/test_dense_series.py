"""Queries over days that hold many more rows than those of the given tables."""

import datetime as dt
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import features
from chronolith.plans import catalogue
from chronolith.sources import parsers


def test_maps_of_counts_of_any_width(spark, tmp_path):
    """Counts that fill five columns, that are the mark of a missing value, and that are wider than a column."""
    counts = [9999, 13333, 12345, 100_001, 7, 999, 9998]
    ids = spark.range(sum(counts)).withColumnRenamed("id", "event_id")
    ends = np.cumsum(counts).tolist()
    station = F.expr("case " + " ".join(f"when event_id < {e} then {i}" for i, e in enumerate(ends)) + " end").cast("long")
    rows = ids.select("event_id", F.lit(dt.datetime(2024, 1, 5, 7)).cast("timestamp_ntz").alias("ts"), station.alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("props"))
    rows.write.parquet(f"file://{tmp_path}/events.parquet")
    got = {(r.lat, r.lon): r.tec for r in catalogue.QUERIES["ionex_maps"](spark, f"file://{tmp_path}").collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(lat, lon): tec for lat, lon, tec in db.sql(f"SELECT lat, lon, tec FROM ({catalogue.ORACLES['ionex_maps']})").fetchall()}
    assert got == want and got[20.0, -30.0] == 999.9 and got[20.0, 60.0] == 10000.1


def test_map_numbers_that_touch(spark):
    line = lambda text, tag: f"{text:<60}{tag}"
    axis = lambda lat: line(f"  {lat:6.1f}{0.0:6.1f}{10.0:6.1f}{5.0:6.1f}{450.0:6.1f}", "LAT/LON1/LON2/DLON/H")
    text = "\n".join([line("    -1", "EXPONENT"), line("", "START OF TEC MAP"), line("  2024     1     2     0     0     0", "EPOCH OF CURRENT MAP"), axis(10.0), "1333313334 9999", axis(0.0), "   12-1234-1000", axis(-10.0), "1333313334", line("", "END OF TEC MAP")])
    got = parsers.ionosphere_maps(spark.createDataFrame([(text,)], "text string"), "text").collect()
    assert [(r.lat, r.lon, r.tec and round(r.tec, 6)) for r in got] == [(10.0, 0.0, 1333.3), (10.0, 5.0, 1333.4), (10.0, 10.0, None), (0.0, 0.0, 1.2), (0.0, 5.0, -123.4), (0.0, 10.0, -100.0)]


def test_dense_range_frames(spark):
    """Frames of up to 300,000 rows: a window goes through 4.5e10 rows for these."""
    n, many = 300_000, 1000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", F.timestamp_micros(F.col("id") * 100).cast("timestamp_ntz").alias("t"), (F.col("id") * 7919 % many + 1).cast("double").alias("v"))
    began = time.time()
    got = np.array(features.range_variation(df, "v", "t", ["k"], 60_000_000, "x").orderBy("id").select("x").toPandas()["x"])
    assert time.time() - began < 60
    v = np.arange(n) * 7919 % many + 1.0
    for i in (1, 2, 1000, 77_777, n - 1):
        assert got[i] == pytest.approx(min(v[: i + 1].std(ddof=1) / v[: i + 1].mean(), 1.0), rel=1e-12)
    assert np.isnan(got[0])


def test_range_frames_of_odd_values(spark):
    """Equal times see each other; nulls are no values, large ones leave the frames behind them exact, and rows without a time are each other's frame."""
    v = [1.0, None, float("inf"), 1e15, 1e15, 3.0, 4.0, 0.0, 0.0, -1.0, 1.0, None, 5.0, float("nan"), 2.0, 3.0]
    at = [0, 0, 10, 20, 30, 100, 100, 200, 201, 300, 300, 400, 500, 600, 700, 701]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), x) for i, (s, x) in enumerate(zip(at, v))] + [(90, None, 1.0), (91, None, 2.0)]
    got = {r.i: r.x for r in features.range_variation(spark.createDataFrame(rows, "i int, t timestamp_ntz, v double"), "v", "t", [], 50_000_000, "x").collect()}
    assert len(got) == len(rows)
    assert got[0] is None and got[1] is None and got[2] == got[3] == got[4] == 1.0
    assert got[5] == got[6] == pytest.approx(0.5**0.5 / 3.5)
    assert [got[i] for i in (7, 8, 9, 10, 11, 12, 13)] == [None] * 7
    assert got[14] is None and got[15] == pytest.approx(0.5**0.5 / 2.5) and got[90] == got[91] == pytest.approx(0.5**0.5 / 1.5)
