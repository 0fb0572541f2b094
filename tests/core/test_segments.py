"""Scans and quantiles in parts, against plain windows and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith.operators import clean, features, ordered, segments

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def series(spark):
    """Two keys and a null one, uneven times with gaps of days, repeated times, nulls, and a row without a time."""
    rng = random.Random(4)
    rows, i = [], 0
    for key, n in ((1, 400), (2, 3), (None, 40)):
        t = 1_700_000_000
        for _ in range(n):
            t += rng.choice([0, 60, 600, 3600, 86_400 * 3])
            i += 1
            rows.append((key, t, i, rng.choice([None, float(rng.randrange(9))])))
    rows.append((1, None, 0, 4.0))
    df = spark.createDataFrame(rows, "k long, s long, i long, v double")
    return df.withColumn("t", F.timestamp_seconds("s").cast("timestamp_ntz")).repartition(4).cache()


def both(got, want):
    names = sorted(want.columns)
    a, b = (sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(names).collect()), key=str) for df in (got, want))
    assert a == b


@pytest.mark.parametrize("width", [HOUR, 7 * HOUR, segments.DAY_US, 400 * segments.DAY_US])
def test_scan_is_a_window(series, width):
    w = Window.partitionBy("k").orderBy("t", "i")
    up, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.col("v")
    got = segments.scan(series, ["k"], ["t", "i"], width, sums={"n": F.lit(1), "s": v}, lasts={"l": v}, nexts={"x": v}, lags={"g": v, "v": F.col("i")}, leads={"d": v})
    both(got, series.withColumns({"n": F.sum(F.lit(1)).over(up), "s": F.sum("v").over(up), "l": F.last("v", True).over(up), "x": F.first("v", True).over(on), "g": F.lag("v").over(w), "d": F.lead("v").over(w)}).withColumn("v", F.lag("i").over(w)))


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_overlapping_is_a_window(series, size):
    w = Window.partitionBy("k").orderBy("t", "i")
    blocks, inner = segments.overlapping(series, ["k"], ["t", "i"], before=5, after=2, size=size, width_us=9 * HOUR)
    of = lambda x: {"a": F.avg("v").over(x.rowsBetween(-5, 2)), "b": F.lag("v", 5).over(x), "c": F.lead("v", 2).over(x), "d": F.collect_list("i").over(x.rowsBetween(-5, -1)).cast("string")}
    both(segments.own(blocks.withColumns(of(inner))), series.withColumns(of(w)))


def test_range_frame_over_bucket_ends(spark):
    rows = [(1, s, float(s % 7 + 1)) for s in range(86_400 * 2 - 300, 86_400 * 2 + 300, 7)] + [(1, 0, 3.0), (None, 5, 1.0)]
    df = spark.createDataFrame(rows, "k long, s long, v double").withColumn("t", F.timestamp_seconds("s").cast("timestamp_ntz"))
    frame = Window.partitionBy("k").orderBy("s").rangeBetween(-59, 0)
    want = df.withColumn("x", F.try_divide(F.stddev_samp("v").over(frame), F.avg("v").over(frame)))
    both(features.range_variation(df, "v", "t", ["k"], 60_000_000, "x"), want.withColumn("x", F.when(F.col("x").isNotNull(), F.least(F.col("x"), F.lit(1.0)))))


def test_rate_and_spread_are_both_steps(series):
    own = series.where("t is not null")
    rate = features.rate_of_change(own, "v", "t", ["k"], ties=["i"])
    both(features.rate_and_spread(own, "v", "t", ["k"], 6, ties=["i"]), features.rolling_std(rate, "rot", "t", ["k"], 6, ties=["i"]))


def test_one_series_is_many_tasks(spark):
    df = spark.range(200 * 24).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("t"), F.rand(3).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (features.rate_of_change(df, "v", "t", ["k"]), features.storm(df, "v", "t", ["k"]), clean.fill_gaps(df, "t", ["v"], ["k"], 2), clean.resample(df, "t", "1 hour", {"v": "max"}, ["k"])):
            rows = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert len(rows) == 8 and max(rows) < 0.3 * sum(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("kind", ["outlier", "ties", "heavy"])
def test_quantiles_under_skew(spark, kind):
    rng = np.random.default_rng(1)
    v = {"outlier": np.append(rng.random(50_000), 999.0), "ties": rng.integers(0, 4, 50_000).astype(float), "heavy": np.exp(rng.normal(0, 9, 50_000))}[kind]
    df = spark.createDataFrame([(i % 3 > 0, float(x)) for i, x in enumerate(v)] + [(True, None), (False, float("nan"))], "k boolean, v double")
    p = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    assert np.allclose(ordered.quantiles(df, "v", [], p).first().q, np.quantile(v, p), rtol=1e-12)
    for r in ordered.quantiles(df, "v", ["k"], p).collect():
        own = v[np.arange(len(v)) % 3 > 0] if r.k else v[np.arange(len(v)) % 3 == 0]
        assert r.n == len(own) and np.allclose(r.q, np.quantile(own, p), rtol=1e-12)
    if kind != "ties":
        steps = sorted(r["count"] for r in ordered.stepped(df, "v", [], [0.25, 0.75]).groupBy("_step").count().collect())
        assert len(steps) == 5 and all(n < 0.01 * len(v) for n in steps[:2])  # what is ranked
    got = clean.outliers(df.where("not isnan(v)"), ["v"], [], 3.0)
    if kind == "outlier":
        assert got.where("v is null").count() == 2  # it, and the null
