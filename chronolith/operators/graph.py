"""Station graphs as edge tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions.expressions import EARTH_KM, haversine_km, micros
from chronolith.operators.segments import DAY_US

KM_PER_DEGREE = 111.1


def distances(stations: DataFrame) -> DataFrame:
    """(src, dst, dist_km) of all ordered pairs: the matrix in long form, as large as its result."""
    a, b = (stations.select(F.col("id").alias(n), F.col("lat").alias(f"lat_{n}"), F.col("lon").alias(f"lon_{n}")) for n in ("src", "dst"))
    pairs = a.join(b, F.col("src") != F.col("dst"))
    return pairs.select("src", "dst", haversine_km(F.col("lat_src"), F.col("lon_src"), F.col("lat_dst"), F.col("lon_dst")).alias("dist_km"))


def _cells(band: Column, most_km: float, height: float) -> Column:
    """How many cells of longitude a band has: each at least as wide as a pair at most most_km apart can be, with one end in the band and the other in it or a neighbour."""
    furthest = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * height, F.lit(90.0))
    reach = F.sin(F.least(F.lit(most_km / (2 * EARTH_KM)), F.pi() / 2)) / F.greatest(F.cos(F.radians(furthest)), F.lit(1e-9))
    width = 2 * F.degrees(F.asin(F.least(reach, F.lit(1.0)))) + 1e-9
    return F.greatest(F.floor(360 / width), F.lit(1))


def near(stations: DataFrame, most_km: float) -> DataFrame:
    """(src, dst, dist_km) of ordered pairs at most most_km apart: an equi-join on bands of latitude, each as high as most_km, and cells of longitude within them."""
    height = most_km / KM_PER_DEGREE
    band = F.floor(F.col("lat") / height)
    cell = lambda lon, n: F.pmod(F.floor((lon + 180) / 360 * n), n)
    a = stations.select(F.col("id").alias("src"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    a = a.withColumn("n", _cells(F.col("band"), most_km, height)).withColumn("own", cell(F.col("lon_a"), F.col("n")))
    a = a.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("own") + d, F.col("n")) for d in (-1, 0, 1)])))).drop("n", "own")
    b = stations.select(F.col("id").alias("dst"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), band.alias("band"))
    b = b.withColumn("cell", cell(F.col("lon_b"), _cells(F.col("band"), most_km, height)))
    d = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.join(b, ["band", "cell"]).where("src <> dst").select("src", "dst", d.alias("dist_km")).where(F.col("dist_km") <= most_km)


#: How many pairs a station may meet in the cells of a ring, on average, before the ring is made smaller.
CROWD = 32


def _crowd(places: DataFrame, km: float) -> float:
    """The mean number of places in a place's cell, of cells as near() makes them: one count by cell."""
    height = km / KM_PER_DEGREE
    band = F.floor(F.col("lat") / height)
    n = _cells(band, km, height)
    cells = places.groupBy(band.alias("band"), F.pmod(F.floor((F.col("lon") + 180) / 360 * n), n).alias("cell")).agg(F.count("*").alias("c"))
    row = cells.agg(F.sum(F.col("c") * F.col("c")).alias("met"), F.sum("c").alias("n")).first()
    return row["met"] / row["n"] if row["n"] else 0.0


def closest_km(stations: DataFrame, begin_km: float | None = None) -> DataFrame:
    """One row, dist_km: the least distance of two stations that aren't at one place; null if there is none. Runs jobs when it is called.

    Stations at one place are one. The ring that is looked in begins at what evenly spread stations would have, is made
    smaller while its cells are crowded, and wider while it holds no pair; no pair closer than a ring means that few fit into
    the next one, so the work stays in proportion to the stations, however they lie.
    """
    places = stations.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("id").alias("id"))
    km = begin_km or max(1e-6, 0.25 * EARTH_KM / max(places.count(), 1))
    while _crowd(places, km) > CROWD and km > 1e-9:
        km /= 4
    least = None
    while least is None and km <= 4 * math.pi * EARTH_KM:
        least = near(places, km).where("dist_km > 0").agg(F.min("dist_km")).first()[0]
        km *= 4
    return stations.sparkSession.range(1).select(F.lit(least).cast("double").alias("dist_km"))


MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
#: Times at once in a task's matrices.
_TIMES = 4096


def _moments(group: pa.Table) -> pa.Table:
    """Sums over the times at which both stations of a pair have a value, of all pairs of two blocks of stations in a bucket of time: products of matrices with a row a time and a column a station."""
    names, key = np.unique(group.column("key").to_numpy(), return_inverse=True)
    times, at = np.unique(group.column("at").to_numpy(), return_inverse=True)
    value, block = group.column("v").to_numpy(), group.column("block").to_numpy()
    one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
    side = np.zeros(len(names), np.int64)
    side[key] = block
    a, b = np.flatnonzero(side == one), np.flatnonzero(side == two)
    total = [np.zeros((len(a), len(b))) for _ in MOMENTS]
    for start in range(0, len(times), _TIMES):
        on = (at >= start) & (at < start + _TIMES)
        x, there = np.zeros((min(_TIMES, len(times) - start), len(names))), np.zeros((min(_TIMES, len(times) - start), len(names)))
        x[at[on] - start, key[on]], there[at[on] - start, key[on]] = value[on], 1
        xa, xb, ta, tb = x[:, a], x[:, b], there[:, a], there[:, b]
        for i, (p, q) in enumerate(((ta, tb), (xa, tb), (ta, xb), (xa * xa, tb), (ta, xb * xb), (xa, xb))):
            total[i] += p.T @ q
    i, j = np.nonzero((total[0] > 0) & (names[a][:, None] != names[b][None, :] if one != two else names[a][:, None] < names[b][None, :]))
    flip = names[a][i] > names[b][j]  # the smaller key is src
    of = lambda k, other: np.where(flip, total[other][i, j], total[k][i, j])
    columns = [total[0][i, j].astype(np.int64), of(1, 2), of(2, 1), of(3, 4), of(4, 3), total[5][i, j]]
    kind = group.schema.field("key").type
    return pa.table({"src": pa.array(np.where(flip, names[b][j], names[a][i]), kind), "dst": pa.array(np.where(flip, names[a][i], names[b][j]), kind), **dict(zip(MOMENTS, map(pa.array, columns)))})


def correlations(series: DataFrame, value: str, time: str = "t", key: str = "station_id", blocks: int = 1, width_us: int = DAY_US) -> DataFrame:
    """(src, dst, corr, n) of ordered pairs src < dst, over the times at which both have a value; a constant series has 0. Duplicates at a time are averaged.

    No row stands for a pair and a time: a task has a bucket of time and two blocks of stations (of some hundreds each;
    `blocks` in all), gives the pairs' sums in it, and these are added. A row is moved `blocks` times. Values are
    taken from their station's least, so that the sums of large values don't cancel.
    """
    own = series.where(F.col(value).isNotNull() & F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("key"), micros(time).alias("at")).agg(F.avg(value).alias("v"))
    least = own.groupBy("key").agg(F.min("v").alias("least"))
    own = own.join(least, "key").select("key", "at", (F.col("v") - F.col("least")).alias("v"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
    other = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = own.select("*", F.explode(other).alias("_o")).select("key", "at", "v", "block", F.least("block", "_o").alias("one"), F.greatest("block", "_o").alias("two"))
    kind = series.schema[key].dataType.simpleString()
    parts = dealt.groupBy(F.floor(F.col("at") / width_us).alias("bucket"), "one", "two").applyInArrow(lambda group: _moments(group), f"src {kind}, dst {kind}, n long, " + ", ".join(f"{m} double" for m in MOMENTS[1:]))
    sums = parts.groupBy("src", "dst").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    mean = lambda m: F.col(m) / F.col("n")

    def spread(square: str, plain: str) -> Column:
        var = mean(square) - mean(plain) * mean(plain)
        return F.when(var > 1e-12 * mean(square), F.sqrt(var))  # less is rounding: a constant

    r = F.try_divide(mean("sxy") - mean("sx") * mean("sy"), spread("sxx", "sx") * spread("syy", "sy"))
    return sums.select("src", "dst", F.coalesce(r, F.lit(0.0)).alias("corr"), "n")


def linked(stations: DataFrame, most_km: float, correlated: DataFrame, least: float) -> DataFrame:
    """(src, dst, dist_km) of ordered pairs that are near, or whose correlation (of correlations()) is at least `least` either way."""
    pairs = correlated.where(F.abs("corr") >= least).select("src", "dst")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    a, b = (stations.select(F.col("id").alias(n), F.col("lat").alias(f"lat_{n}"), F.col("lon").alias(f"lon_{n}")) for n in ("src", "dst"))
    far = both.join(a, "src").join(b, "dst").select("src", "dst", haversine_km(F.col("lat_src"), F.col("lon_src"), F.col("lat_dst"), F.col("lon_dst")).alias("dist_km"))
    return near(stations, most_km).unionByName(far).dropDuplicates(["src", "dst"])


def weights(edges: DataFrame, closest: DataFrame, stations: DataFrame, self_loops: bool = True) -> DataFrame:
    """(src, dst, weight): the inverse distance over that of the closest pair (one row, dist_km); stations at one place have none; self loops weigh 1."""
    top = closest.select(F.col("dist_km").alias("_least"))
    out = edges.crossJoin(F.broadcast(top)).select("src", "dst", F.coalesce(F.try_divide(F.col("_least"), F.col("dist_km")), F.lit(0.0)).alias("weight")).where("weight <> 0")
    return out.unionByName(stations.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))) if self_loops else out


META = "most_km double, least_corr double, n_nodes long, n_edges long"


def save(edges: DataFrame, stations: DataFrame, folder: str, most_km: float, least_corr: float) -> None:
    """Edges and stations as Parquet and the settings as JSON below the folder."""
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    stations.write.mode("overwrite").parquet(f"{folder}/stations")
    spark = edges.sparkSession
    spark.createDataFrame([(most_km, least_corr, stations.count(), spark.read.parquet(f"{folder}/edges").count())], META).write.mode("overwrite").json(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, stations, settings: one row) of save()."""
    return spark.read.parquet(f"{folder}/edges"), spark.read.parquet(f"{folder}/stations"), spark.read.schema(META).json(f"{folder}/meta")


def neighbour_mean(edges: DataFrame, features: DataFrame, value: str, time: str = "t", key: str = "station_id") -> DataFrame:
    """(station, time, mean): the weighted mean of the neighbours' values at each time."""
    msg = edges.join(features.select(F.col(key).alias("src"), time, value).where(F.col(value).isNotNull()), "src")
    return msg.groupBy(F.col("dst").alias(key), time).agg(F.try_divide(F.sum(F.col("weight") * F.col(value)), F.sum("weight")).alias("neighbour_mean"))


def attention(edges: DataFrame, score: str) -> DataFrame:
    """edges with alpha: the softmax of score over the edges into a node; the largest score is taken off first."""
    into = Window.partitionBy("dst")
    e = F.exp(F.col(score) - F.max(score).over(into))
    return edges.withColumn("_e", e).withColumn("alpha", F.col("_e") / F.sum("_e").over(into)).drop("_e")
