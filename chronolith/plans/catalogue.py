"""The registered queries over the driver's tables, each with the SQL that checks it. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import expressions as X
from chronolith.operators import asof, clean, events, features, forecast, graph, ordered, regress, verify
from chronolith.plans import views as V
from chronolith.sources import parsers, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with its SQL. Doubles of the result are rounded."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Cleaning


@query(f"WITH {V.GRID} SELECT station_id, t, round(s4, 6) AS s4, round(tec, 6) AS tec FROM grid")
def resample_densify(spark, sf):
    return V.grid(spark, sf)


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS t, round(avg(value), 6) AS value FROM events GROUP BY 1")
def resample_scalar_mean(spark, sf):
    return clean.resample(V.events(spark, sf), "t", "6 hours", {"value": "mean"}, [], dense=False)


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS t, round(max(value), 6) AS value FROM events GROUP BY 1")
def resample_scalar_max(spark, sf):
    return clean.resample(V.events(spark, sf), "t", "6 hours", {"value": "max"}, [], dense=False)


@query(f"""WITH {V.MAPS}, ends AS (SELECT min(epoch) AS lo, max(epoch) AS hi FROM maps),
steps AS (SELECT lat, lon, t AS epoch FROM (SELECT DISTINCT lat, lon FROM maps), (SELECT unnest(generate_series(lo, hi, INTERVAL '30 days')) AS t FROM ends)),
b AS (SELECT s.lat, s.lon, s.epoch, m.epoch AS pe, m.tec AS pv FROM steps s ASOF LEFT JOIN maps m ON m.lat = s.lat AND m.lon = s.lon AND s.epoch >= m.epoch),
f AS (SELECT s.lat, s.lon, s.epoch, m.epoch AS ne, m.tec AS nv FROM steps s ASOF LEFT JOIN maps m ON m.lat = s.lat AND m.lon = s.lon AND s.epoch <= m.epoch)
SELECT lat, lon, epoch, round(CASE WHEN pv IS NULL THEN NULL WHEN nv IS NULL OR ne = pe THEN pv ELSE pv + (nv - pv) * (epoch_us(epoch) - epoch_us(pe)) / (epoch_us(ne) - epoch_us(pe)) END, 6) AS tec FROM b JOIN f USING (lat, lon, epoch)""")
def upsample_time_linear(spark, sf):
    # Cells and ends come from the rows themselves, so that the maps are aggregated once.
    rows = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("lat"), F.col("l_linenumber").cast("long").alias("lon"), F.col("l_shipdate").alias("epoch"))
    ends = rows.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))  # one row
    steps = ends.select(F.sequence("lo", "hi", F.expr("interval 30 days")).alias("steps"))
    grid = rows.select("lat", "lon").distinct().crossJoin(F.broadcast(steps)).select("lat", "lon", F.explode("steps").alias("epoch"))
    return clean.upsample(V.maps(spark, sf), grid, "epoch", "tec", ["lat", "lon"])


_IQR = f"WITH {V.OBS}, q AS (SELECT station_id, quantile_cont(s4, 0.25) AS a, quantile_cont(s4, 0.75) AS b FROM obs GROUP BY 1)"


@query(f"{_IQR} SELECT event_id, station_id, round(CASE WHEN s4 < a - 1.5 * (b - a) OR s4 > b + 1.5 * (b - a) THEN NULL ELSE s4 END, 6) AS s4 FROM obs JOIN q USING (station_id)")
def iqr_outlier_null(spark, sf):
    return clean.outliers(V.obs(spark, sf), ["s4"], ["station_id"], 1.5).select("event_id", "station_id", "s4")


@query(f"{_IQR} SELECT event_id, station_id, round(CASE WHEN s4 < a - 1.5 * (b - a) THEN a - 1.5 * (b - a) WHEN s4 > b + 1.5 * (b - a) THEN b + 1.5 * (b - a) ELSE s4 END, 6) AS s4 FROM obs JOIN q USING (station_id)")
def iqr_outlier_clip(spark, sf):
    return clean.outliers(V.obs(spark, sf), ["s4"], ["station_id"], 1.5, "clip").select("event_id", "station_id", "s4")


_NUM = f"""WITH {V.GRID}, num AS (SELECT station_id, t, s4, row_number() OVER (PARTITION BY station_id ORDER BY t) AS i FROM grid),
known AS (SELECT * FROM num WHERE s4 IS NOT NULL),
b AS (SELECT n.station_id, n.t, n.i, n.s4, k.i AS pi, k.s4 AS pv FROM num n ASOF LEFT JOIN known k ON n.station_id = k.station_id AND n.i >= k.i),
f AS (SELECT n.station_id, n.i, k.i AS ni, k.s4 AS nv FROM num n ASOF LEFT JOIN known k ON n.station_id = k.station_id AND n.i <= k.i)"""


@query(f"{_NUM} SELECT station_id, t, round(CASE WHEN s4 IS NOT NULL THEN s4 WHEN i - pi <= 2 OR ni - i <= 2 THEN CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END END, 6) AS s4 FROM b JOIN f USING (station_id, i)")
def gap_fill_linear(spark, sf):
    return clean.fill_gaps(V.grid(spark, sf).drop("tec"), "t", ["s4"], ["station_id"], 2)


@query(f"{_NUM} SELECT station_id, t, round(CASE WHEN s4 IS NOT NULL THEN s4 WHEN ni - pi - 1 <= 2 THEN pv + (nv - pv) * (i - pi) / (ni - pi) END, 6) AS s4 FROM b JOIN f USING (station_id, i)")
def gap_fill_strict(spark, sf):
    return clean.fill_gaps(V.grid(spark, sf).drop("tec"), "t", ["s4"], ["station_id"], 2, strict=True)


@query(f"WITH {V.OBS} SELECT 's4' AS feature, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL SELECT 'v', round(min(tec), 6), round(CASE WHEN max(tec) = min(tec) THEN max(tec) + 1 ELSE max(tec) END, 6) FROM obs UNION ALL SELECT 'one', 3.0, 4.0")
def minmax_fit(spark, sf):
    own = V.obs(spark, sf).withColumn("v", F.col("tec")).withColumn("one", F.lit(3.0))
    return clean.fit_scaler(own, ["s4", "v", "one"], X.BOUNDS)


@query(f"WITH {V.OBS}, e AS (SELECT min(tec) AS lo, max(tec) AS hi FROM obs) SELECT event_id, round((tec - lo) / (hi - lo), 6) AS tec FROM obs, e")
def minmax_transform(spark, sf):
    own = V.obs(spark, sf)
    return clean.scale(own, clean.fit_scaler(own, ["tec"]), ["tec"]).select("event_id", "tec")


@query(f"WITH {V.OBS} SELECT event_id, round(s4 * 300 - 250, 6) AS s4 FROM obs")
def minmax_inverse(spark, sf):
    own = V.obs(spark, sf)
    params = clean.fit_scaler(own, ["s4"], {"s4": X.BOUNDS["dst"]})
    return clean.scale(own, params, ["s4"], inverse=True).select("event_id", "s4")


# As-of joins


def _nearest(left: str, right: str, value: str, tolerance: str, keyed: bool) -> str:
    on = "l.station_id = r.station_id AND " if keyed else ""
    key = "station_id, " if keyed else ""
    group = "1, 2" if keyed else "1"
    side = lambda sign: f"SELECT l.event_id, l.t, r.t AS rt, r.v FROM {left} l ASOF LEFT JOIN r ON {on}l.t {sign} r.t"
    return f"""r AS (SELECT {key}t, max_by({value}, event_id) AS v FROM {right} GROUP BY {group}),
b AS ({side('>=')}), f AS ({side('<=')})
SELECT event_id, b.t, round(CASE WHEN b.rt IS NOT NULL AND (f.rt IS NULL OR b.t - b.rt <= f.rt - f.t) THEN CASE WHEN b.t - b.rt <= {tolerance} THEN b.v END WHEN f.rt - f.t <= {tolerance} THEN f.v END, 6) AS {value} FROM b JOIN f USING (event_id)"""


@query(f"WITH {V.AURORA}, {V.WIND}, " + _nearest("aur", "wind", "bz", "INTERVAL '30 minutes'", False))
def asof_nearest_tol(spark, sf):
    return asof.asof_join(V.aurora(spark, sf).select("event_id", "t"), V.wind(spark, sf).withColumnRenamed("event_id", "seq"), "t", ["bz"], 30 * 60_000_000, sequence="seq", bucket_us=6 * 3_600_000_000)


@query(f"WITH {V.AURORA}, {V.GEO}, " + _nearest("aur", "geo", "dst", "INTERVAL '3 hours'", True))
def asof_nearest_by(spark, sf):
    out = asof.asof_join(V.aurora(spark, sf).select("event_id", "t", "station_id"), V.geomag(spark, sf).withColumnRenamed("event_id", "seq"), "t", ["dst"], 3 * 3_600_000_000, ["station_id"], sequence="seq", bucket_us=24 * 3_600_000_000)
    return out.select("event_id", "t", "dst")


@query(f"""WITH {V.GEO}, r AS (SELECT t, max_by(dst, event_id) AS dst FROM geo GROUP BY 1), e AS (SELECT time_bucket(INTERVAL '1 hour', min(t)) AS lo, max(t) AS hi FROM geo),
g AS (SELECT unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS t FROM e)
SELECT g.t, round(CASE WHEN g.t - r.t <= INTERVAL '1 hour' THEN r.dst END, 6) AS dst FROM g ASOF LEFT JOIN r ON g.t >= r.t""")
def asof_backward_grid(spark, sf):
    geo = V.geomag(spark, sf)
    ends = geo.groupBy(F.window("t", "1 hour").alias("w")).agg(F.max("t").alias("t")).agg(F.min("w.start").alias("lo"), F.max("t").alias("hi"))
    steps = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("t"))
    return asof.asof_join(steps, geo, "t", ["dst"], 3_600_000_000, direction="backward", sequence="event_id", bucket_us=24 * 3_600_000_000)


# Features

_ROT = f"WITH {V.OBS}, d AS (SELECT *, lag(tec) OVER w AS ptec, lag(t) OVER w AS pt FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY t, event_id)), rot AS (SELECT station_id, event_id, t, (tec - ptec) / nullif((epoch_us(t) - epoch_us(pt)) / 60e6, 0) AS rot FROM d)"


@query(f"{_ROT} SELECT event_id, round(rot, 6) AS rot FROM rot")
def rot(spark, sf):
    return features.rate_of_change(V.obs(spark, sf), "tec", "t", ["station_id"], ties=["event_id"]).select("event_id", "rot")


@query(f"""WITH {V.GRID}, d AS (SELECT station_id, t, (tec - lag(tec) OVER w) / 60 AS rot FROM grid WINDOW w AS (PARTITION BY station_id ORDER BY t)),
n AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY t) AS i FROM d)
SELECT a.station_id, a.t, round(CASE WHEN count(b.rot) >= 3 THEN stddev_samp(b.rot) END, 6) AS roti FROM n a JOIN n b ON a.station_id = b.station_id AND b.i BETWEEN a.i - 11 AND a.i GROUP BY 1, 2""")
def roti(spark, sf):
    return features.rate_and_spread(V.grid(spark, sf), "tec", "t", ["station_id"]).select("station_id", "t", "roti")


@query(f"""WITH {V.OBS}, c AS (SELECT event_id, count(*) OVER w AS n, stddev_samp(s4) OVER w / nullif(avg(s4) OVER w, 0) AS cv FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY epoch_us(t) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n > 1 AND cv IS NOT NULL THEN greatest(least(cv, 1), 0) END, 6) AS s4_index FROM c""")
def range_frame_cv(spark, sf):
    return features.range_variation(V.obs(spark, sf).select("station_id", "t", "event_id", "s4"), "s4", "t", ["station_id"], 21_600_000_000).select("event_id", "s4_index")


@query(f"""WITH {V.WIND} SELECT event_id, round(CASE WHEN bz < 0 THEN v_sw * -bz ELSE 0 END, 6) AS epsilon,
round(v_sw ** (4.0 / 3) * abs(bz) ** (2.0 / 3) * sin(atan2(abs(bz), CASE WHEN bz = 0 THEN 1e-9 ELSE abs(bz) END) / 2) ** (8.0 / 3), 6) AS newell, round(-v_sw * bz / 1000, 6) AS ey, round(n_p * v_sw * v_sw, 6) AS beta_sw FROM wind""")
def coupling(spark, sf):
    return V.wind(spark, sf).withColumns(X.coupling(F.col("bz"), F.col("v_sw"), F.col("n_p"))).select("event_id", "epsilon", "newell", "ey", "beta_sw")


@query(f"""WITH {V.OBS}, {V.STATIONS}, l AS (SELECT event_id, dayofyear(t) AS doy, hour(t) + minute(t) / 60.0::DOUBLE + lon / 15 AS h FROM obs JOIN stations ON id = station_id), m AS (SELECT event_id, doy, h - 24 * floor(h / 24) AS lt FROM l)
SELECT event_id, round(lt, 6) AS lt_hour, CAST(lt >= 18 AND lt <= 22 AS BIGINT) AS post_sunset, round(sin(2 * pi() * lt / 24), 6) AS sin_hour_1, round(cos(2 * pi() * lt / 24), 6) AS cos_hour_1, round(sin(4 * pi() * lt / 24), 6) AS sin_hour_2, round(cos(4 * pi() * lt / 24), 6) AS cos_hour_2,
round(sin(2 * pi() * doy / 365.25), 6) AS sin_doy_1, round(cos(2 * pi() * doy / 365.25), 6) AS cos_doy_1, round(sin(4 * pi() * doy / 365.25), 6) AS sin_doy_2, round(cos(4 * pi() * doy / 365.25), 6) AS cos_doy_2 FROM m""")
def harmonics(spark, sf):
    own = V.obs(spark, sf).join(V.stations(spark, sf).withColumnRenamed("id", "station_id"), "station_id")
    made = X.harmonics(F.col("t"), F.col("lon"))
    return own.withColumns(made).select("event_id", *made)


_STORM = f"""WITH {V.GEO}, s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY station_id) AS n, lag(dst) OVER w AS a, lead(dst) OVER w AS b FROM geo WINDOW w AS (PARTITION BY station_id ORDER BY t, event_id)),
g AS (SELECT *, CASE WHEN i = 1 THEN b - dst WHEN i = n THEN dst - a ELSE (b - a) / 2 END AS gradient, i > 1 AND dst <= -50 AND a > -50 AS onset FROM s)"""


@query(f"{_STORM} SELECT x.event_id, round(coalesce((epoch_us(x.t) - epoch_us(max(y.t))) / 3.6e9, 72), 6) AS hours_since_onset FROM g x LEFT JOIN g y ON y.station_id = x.station_id AND y.onset AND y.i <= x.i GROUP BY x.event_id, x.t")
def storm_onset_hours(spark, sf):
    return features.storm(V.geomag(spark, sf), "dst", "t", ["station_id"], ties=["event_id"]).select("event_id", "hours_since_onset")


@query(f"{_STORM} SELECT event_id, round(gradient, 6) AS gradient, CAST(CASE WHEN i = 1 THEN 0 WHEN dst <= -50 THEN CASE WHEN gradient < 0 THEN 2 ELSE 3 END WHEN gradient > 20 THEN 1 ELSE 0 END AS BIGINT) AS phase FROM g")
def storm_phase(spark, sf):
    return features.storm(V.geomag(spark, sf), "dst", "t", ["station_id"], ties=["event_id"]).select("event_id", "gradient", "phase")


@query(f"WITH {V.GEO} SELECT event_id, CAST((dst < -30)::INT + (dst < -100)::INT + (dst < -200)::INT AS BIGINT) AS intensity FROM geo")
def storm_intensity(spark, sf):
    return V.geomag(spark, sf).select("event_id", X.storm_intensity(F.col("dst")).alias("intensity"))


@query(f"{_STORM} SELECT x.event_id, round(avg(y.dst), 6) AS mean_24h FROM g x JOIN g y ON y.station_id = x.station_id AND y.i BETWEEN x.i - 47 AND x.i GROUP BY 1")
def cumulative_mean_24h(spark, sf):
    return features.rolling_mean(V.geomag(spark, sf), "dst", "t", ["station_id"], ties=["event_id"]).select("event_id", "mean_24h")


@query(f"""WITH {V.WIND}, {V.GEO}, {V.AURORA}, {V.OBS}, {V.STATIONS},
sw0 AS (SELECT event_id, t, bz, v_sw, n_p, CASE WHEN bz < 0 THEN v_sw * -bz ELSE 0 END AS epsilon FROM wind), au AS (SELECT t, max_by(hp_north, event_id) AS hp FROM aur GROUP BY 1),
sb AS (SELECT s.*, a.t AS at, a.hp FROM sw0 s ASOF LEFT JOIN au a ON s.t >= a.t), sa AS (SELECT s.event_id, a.t AS at, a.hp FROM sw0 s ASOF LEFT JOIN au a ON s.t <= a.t),
sw1 AS (SELECT b.event_id, b.t, bz, v_sw, n_p, epsilon, CASE WHEN b.at IS NOT NULL AND (a.at IS NULL OR b.t - b.at <= a.at - b.t) THEN CASE WHEN b.t - b.at <= INTERVAL '1 hour' THEN b.hp END WHEN a.at - b.t <= INTERVAL '1 hour' THEN a.hp END AS hp_north FROM sb b JOIN sa a USING (event_id)),
w AS (SELECT t, max_by(bz, event_id) AS bz, max_by(v_sw, event_id) AS v_sw, max_by(n_p, event_id) AS n_p, max_by(epsilon, event_id) AS epsilon, arg_max_null(hp_north, event_id) AS hp_north FROM sw1 GROUP BY 1), g AS (SELECT t, max_by(dst, event_id) AS dst FROM geo GROUP BY 1),
d AS (SELECT o.event_id, o.station_id, o.t, (tec - lag(tec) OVER k) / nullif((epoch_us(o.t) - epoch_us(lag(o.t) OVER k)) / 60e6, 0) AS rot, row_number() OVER k AS i, dayofyear(o.t) AS doy, hour(o.t) + minute(o.t) / 60.0::DOUBLE + lon / 15 AS h FROM obs o JOIN stations ON id = station_id WINDOW k AS (PARTITION BY station_id ORDER BY t, event_id)),
r AS (SELECT *, CASE WHEN count(rot) OVER f >= 3 THEN stddev_samp(rot) OVER f END AS roti FROM d WINDOW f AS (PARTITION BY station_id ORDER BY i ROWS 11 PRECEDING)),
wb AS (SELECT r.*, w.t AS wt, w.bz, w.v_sw, w.epsilon, w.hp_north FROM r ASOF LEFT JOIN w ON r.t >= w.t), wa AS (SELECT r.event_id, w.t AS wt, w.bz, w.v_sw, w.epsilon, w.hp_north FROM r ASOF LEFT JOIN w ON r.t <= w.t),
gb AS (SELECT r.event_id, g.t AS gt, g.dst FROM r ASOF LEFT JOIN g ON r.t >= g.t), ga AS (SELECT r.event_id, g.t AS gt, g.dst FROM r ASOF LEFT JOIN g ON r.t <= g.t),
j AS (SELECT wb.*, wa.wt AS at, wa.bz AS abz, wa.v_sw AS av, wa.epsilon AS ae, wa.hp_north AS ahp, gb.gt AS bgt, gb.dst AS bdst, ga.gt AS agt, ga.dst AS adst,
CASE WHEN wb.wt IS NOT NULL AND (wa.wt IS NULL OR wb.t - wb.wt <= wa.wt - wb.t) THEN CASE WHEN wb.t - wb.wt <= INTERVAL '30 minutes' THEN 1 END WHEN wa.wt - wb.t <= INTERVAL '30 minutes' THEN 2 END AS pick,
CASE WHEN gb.gt IS NOT NULL AND (ga.gt IS NULL OR wb.t - gb.gt <= ga.gt - wb.t) THEN CASE WHEN wb.t - gb.gt <= INTERVAL '3 hours' THEN 1 END WHEN ga.gt - wb.t <= INTERVAL '3 hours' THEN 2 END AS gpick FROM wb JOIN wa USING (event_id) JOIN gb USING (event_id) JOIN ga USING (event_id))
SELECT event_id, station_id, t, round(rot, 6) AS rot, round(roti, 6) AS roti, round(h - 24 * floor(h / 24), 6) AS lt_hour, round(sin(2 * pi() * doy / 365.25), 6) AS sin_doy_1, round(CASE pick WHEN 1 THEN bz WHEN 2 THEN abz END, 6) AS bz, round(CASE pick WHEN 1 THEN v_sw WHEN 2 THEN av END, 6) AS v_sw, round(CASE pick WHEN 1 THEN epsilon WHEN 2 THEN ae END, 6) AS epsilon, round(CASE pick WHEN 1 THEN hp_north WHEN 2 THEN ahp END, 6) AS hp_north, round(CASE gpick WHEN 1 THEN bdst WHEN 2 THEN adst END, 6) AS dst FROM j""")
def features_step(spark, sf):
    """Every observation with its rates, harmonics, and the nearest wind (with coupling and aurora) and geomagnetic index."""
    six, day = 6 * 3_600_000_000, 24 * 3_600_000_000
    wind = V.wind(spark, sf).drop("station_id")
    wind = wind.withColumns(X.coupling(F.col("bz"), F.col("v_sw"), F.col("n_p")))
    wind = asof.asof_join(wind, V.aurora(spark, sf).withColumnRenamed("event_id", "seq"), "t", ["hp_north"], 3_600_000_000, sequence="seq", bucket_us=six)
    own = features.rate_and_spread(V.obs(spark, sf), "tec", "t", ["station_id"], ties=["event_id"]).join(V.stations(spark, sf).select(F.col("id").alias("station_id"), "lon"), "station_id")
    own = own.withColumns(X.harmonics(F.col("t"), F.col("lon"))).select("event_id", "station_id", "t", "rot", "roti", "lt_hour", "sin_doy_1")
    own = asof.asof_join(own, wind.withColumnRenamed("event_id", "seq"), "t", ["bz", "v_sw", "epsilon", "hp_north"], 30 * 60_000_000, sequence="seq", bucket_us=six)
    return asof.asof_join(own, V.geomag(spark, sf).withColumnRenamed("event_id", "seq"), "t", ["dst"], 3 * 3_600_000_000, sequence="seq", bucket_us=day)


# Graph

_DIST = f"{V.STATIONS}, d AS (SELECT a.id AS src, b.id AS dst, 2 * 6371.0 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) AS dist_km FROM stations a, stations b WHERE a.id <> b.id)"


@query(f"WITH {_DIST} SELECT src, dst, round(dist_km, 6) AS dist_km FROM d")
def haversine_pairs(spark, sf):
    return graph.distances(V.stations(spark, sf))


@query(f"WITH {_DIST} SELECT src, dst, round(dist_km, 6) AS dist_km FROM d WHERE dist_km <= 2000")
def distance_edges(spark, sf):
    return graph.near(V.stations(spark, sf), 2000.0)


@query(f"""WITH {V.GRID}, p AS (SELECT a.station_id AS src, b.station_id AS dst, a.tec AS x, b.tec AS y FROM grid a JOIN grid b ON a.t = b.t AND a.station_id < b.station_id WHERE a.tec IS NOT NULL AND b.tec IS NOT NULL)
SELECT src, dst, count(*) AS n, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) AS corr FROM p GROUP BY 1, 2""")
def correlation_edges(spark, sf):
    return graph.correlations(V.grid(spark, sf), "tec")


_WEIGHTS = f"{_DIST}, w AS (SELECT src, dst, (1 / dist_km) / (SELECT max(1 / dist_km) FROM d WHERE dist_km > 0) AS weight FROM d WHERE dist_km <= 2000 AND dist_km > 0 UNION ALL SELECT id, id, 1.0 FROM stations)"


def _weights(spark, sf):
    s = V.stations(spark, sf)
    return graph.weights(graph.near(s, 2000.0), graph.closest_km(s), s)


@query(f"WITH {_WEIGHTS} SELECT src, dst, round(weight, 6) AS weight FROM w")
def graph_weights(spark, sf):
    return _weights(spark, sf)


@query(f"WITH {V.GRID}, {_WEIGHTS} SELECT dst AS station_id, t, round(sum(weight * s4) / sum(weight), 6) AS neighbour_mean FROM w JOIN grid ON station_id = src WHERE s4 IS NOT NULL GROUP BY 1, 2")
def neighbour_mean(spark, sf):
    return graph.neighbour_mean(_weights(spark, sf), V.grid(spark, sf), "s4")


@query(f"WITH {_WEIGHTS}, z AS (SELECT dst, sum(exp(weight)) AS total FROM w GROUP BY 1) SELECT src, w.dst, round(exp(weight) / total, 6) AS alpha FROM w JOIN z ON z.dst = w.dst")
def attention_softmax(spark, sf):
    return graph.attention(_weights(spark, sf), "weight").select("src", "dst", "alpha")


_LINKED = f"""{V.GRID}, {_DIST}, p AS (SELECT a.station_id AS src, b.station_id AS dst, a.tec AS x, b.tec AS y FROM grid a JOIN grid b ON a.t = b.t AND a.station_id < b.station_id WHERE a.tec IS NOT NULL AND b.tec IS NOT NULL),
c AS (SELECT src, dst FROM p GROUP BY 1, 2 HAVING abs(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0)) >= 0.05),
e AS (SELECT src, dst, dist_km FROM d WHERE dist_km <= 2000 OR EXISTS (SELECT 1 FROM c WHERE (c.src = d.src AND c.dst = d.dst) OR (c.src = d.dst AND c.dst = d.src))),
w AS (SELECT src, dst, (SELECT min(dist_km) FROM d WHERE dist_km > 0) / dist_km AS weight FROM e WHERE dist_km > 0 UNION ALL SELECT id, id, 1.0 FROM stations)"""


@query(f"WITH {_LINKED} SELECT src, dst, round(weight, 6) AS weight FROM w")
def graph_build(spark, sf):
    """Edges by distance or by correlation, weighted."""
    s = V.stations(spark, sf)
    return graph.weights(graph.linked(s, 2000.0, graph.correlations(V.grid(spark, sf), "tec"), 0.05), graph.closest_km(s), s)


# Events and alerts

_EVENTS = f"""{V.GRID}, lv AS (SELECT * FROM (VALUES ('severe', 0.7, 'red', 3, 'Suspend critical GNSS-dependent operations. Switch to INS/backup.'), ('warning', 0.4, 'orange', 2, 'Prepare for signal degradation. Check backup positioning.'), ('watch', 0.3, 'yellow', 1, 'Monitor GNSS performance closely.')) v(level, thr, colour, rk, action)),
m AS (SELECT station_id, level, thr, colour, t, s4, coalesce(s4 >= thr, false) AS onn, row_number() OVER (PARTITION BY station_id, level ORDER BY t) AS i FROM grid, lv),
k AS (SELECT *, i - row_number() OVER (PARTITION BY station_id, level ORDER BY t) AS g FROM m WHERE onn),
e AS (SELECT station_id, level, thr, colour, min(t) AS onset, max(t) AS "end", max(s4) AS peak_s4, avg(s4) AS mean_s4, count(*) * 60 AS duration_min FROM k GROUP BY station_id, level, thr, colour, g HAVING count(*) >= 1),
ev AS (SELECT row_number() OVER (ORDER BY station_id, thr DESC, onset) AS event_id, * EXCLUDE (thr) FROM e)"""


def _events(spark, sf):
    return events.detect(V.grid(spark, sf), "s4", "t", "station_id", 60, 30)


@query(f'WITH {_EVENTS} SELECT event_id, station_id, level, onset, "end", round(peak_s4, 6) AS peak_s4, round(mean_s4, 6) AS mean_s4, duration_min, colour FROM ev')
def detect_events(spark, sf):
    return _events(spark, sf)


@query(f"WITH {V.OBS} SELECT event_id, CASE WHEN s4 >= 0.7 THEN 'severe' WHEN s4 >= 0.4 THEN 'warning' WHEN s4 >= 0.3 THEN 'watch' ELSE 'quiet' END AS level FROM obs")
def classify_levels(spark, sf):
    return V.obs(spark, sf).select("event_id", X.level_of(F.col("s4")).alias("level"))


@query(f"""WITH {V.OBS}, q AS (SELECT quantile_cont(s4, 0.75) AS a, quantile_cont(s4, 0.9) AS b, quantile_cont(s4, 0.99) AS c FROM obs), w AS (SELECT *, greatest(0.15, least(a, 0.4)) AS watch FROM q), x AS (SELECT *, greatest(greatest(0.3, least(b, 0.6)), watch + 0.05) AS warning FROM w)
SELECT round(watch, 6) AS watch, round(warning, 6) AS warning, round(greatest(greatest(0.6, least(c, 0.95)), warning + 0.1), 6) AS severe FROM x""")
def calibrate_thresholds(spark, sf):
    return events.calibrate(V.obs(spark, sf), "s4")


@query(f"""WITH {_EVENTS}, act AS (SELECT * FROM ev WHERE "end" >= TIMESTAMP '2024-01-15')
SELECT format('EVT-{{:05d}}', event_id) AS code, station_id, upper(act.level) AS level, act.colour, action, round(peak_s4, 4) AS peak_s4, (SELECT count(*) FROM act) AS n_active, (SELECT max_by(a.level, l.rk) FROM act a JOIN lv l ON l.level = a.level) AS worst FROM act JOIN lv ON lv.level = act.level""")
def alert_payload(spark, sf):
    return events.alerts(_events(spark, sf), F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'"), "station_id")


@query(f"WITH {V.GRID} SELECT station_id, round(max_by(s4, t) FILTER (WHERE s4 IS NOT NULL), 6) AS s4, round(max_by(tec, t) FILTER (WHERE tec IS NOT NULL), 6) AS tec FROM grid GROUP BY 1")
def latest_per_station(spark, sf):
    return events.latest(V.grid(spark, sf), "t", "station_id", ["s4", "tec"])


_FEATURES = f"""{_EVENTS}, {V.STATIONS}, fr AS (SELECT event_id, station_id, level, round(coalesce(lon, 0.0), 4) AS lon, round(coalesce(lat, 0.0), 4) AS lat, coalesce(country, '') AS country, round(peak_s4, 4) AS peak, duration_min FROM ev LEFT JOIN stations ON id = station_id),
fj AS (SELECT event_id, station_id, level, lon, lat, country, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"event_id":' || event_id || ',"station_id":' || station_id || ',"level":"' || level || '","country":"' || country || '","peak_s4":' || peak || ',"duration_min":' || duration_min || '}}}}' AS feature FROM fr)"""


@query(f"WITH {_FEATURES} SELECT * FROM fj")
def events_geojson_rows(spark, sf):
    return events.map_rows(_events(spark, sf), V.stations(spark, sf), "station_id")


@query(f"""WITH {_FEATURES} SELECT station_id, count(*) AS n_features, '{{"type":"FeatureCollection","features":[' || string_agg(feature, ',' ORDER BY event_id) || ']}}' AS collection FROM fj GROUP BY 1""")
def events_geojson_collections(spark, sf):
    return events.feature_collections(events.map_rows(_events(spark, sf), V.stations(spark, sf), "station_id"), ["station_id"])


_IMPACTS = ", ".join(f"('{sector}', '{level}', '{text}')" for sector, own in X.SECTOR_IMPACTS.items() for level, text in own.items())


@query(f"""WITH {_EVENTS}, act AS (SELECT * FROM ev WHERE "end" >= TIMESTAMP '2024-01-15') SELECT format('EVT-{{:05d}}', event_id) AS code, station_id, upper(act.level) AS level, sector, impact FROM act JOIN (VALUES {_IMPACTS}) v(sector, lv, impact) ON lv = act.level""")
def sector_impacts(spark, sf):
    rows = events.alerts(_events(spark, sf), F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'"), "station_id")
    return events.impacts(rows).select("code", "station_id", "level", "sector", "impact")


def _case(column: str, at: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {v} THEN '{n}'" for n, v in sorted(at.items(), key=lambda x: -x[1])) + " ELSE 'quiet' END"


@query(f"WITH {V.OBS} SELECT event_id, {_case('s4', X.SIGMA_PHI_THRESHOLDS)} AS phase_level, {_case('tec / 25', X.ROTI_THRESHOLDS)} AS rate_level FROM obs")
def classify_other_indices(spark, sf):
    """Levels of the phase and rate indices, for which two columns stand in."""
    return V.obs(spark, sf).select("event_id", X.level_of(F.col("s4"), X.SIGMA_PHI_THRESHOLDS).alias("phase_level"), X.level_of(F.col("tec") / 25, X.ROTI_THRESHOLDS).alias("rate_level"))


@query(f"""WITH {V.GRID}, {V.STATIONS}, l AS (SELECT station_id, max_by(s4, t) FILTER (WHERE s4 IS NOT NULL) AS v FROM grid GROUP BY 1), j AS (SELECT id, lat, lon, coalesce(v, 0) AS s4 FROM stations LEFT JOIN l ON station_id = id)
SELECT id, lat, lon, round(s4, 6) AS s4, CASE WHEN s4 >= 0.7 THEN 'severe' WHEN s4 >= 0.4 THEN 'warning' WHEN s4 >= 0.3 THEN 'watch' ELSE 'quiet' END AS level, CASE WHEN s4 >= 0.7 THEN 'red' WHEN s4 >= 0.4 THEN 'orange' WHEN s4 >= 0.3 THEN 'yellow' ELSE 'green' END AS colour, round(12 + 20 * s4, 6) AS radius FROM j""")
def dashboard_rows(spark, sf):
    return events.dashboard(V.stations(spark, sf), V.grid(spark, sf), "t", "station_id", "s4")


# Verification

_REG = "avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(y_pred - y_true) AS mbe, 1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*) + 1e-9) AS r2"


@query(f"""WITH {V.PAIRS}, p AS (SELECT *, y_true - lag(y_true) OVER (ORDER BY l_orderkey, l_linenumber, y_true, y_pred) AS d FROM pairs), m AS (SELECT {_REG}, count(*) AS n, sqrt(avg(d * d)) AS ref FROM p)
SELECT round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mbe, 6) AS mbe, round(r2, 6) AS r2, n, round(1 - rmse / (ref + 1e-9), 6) AS skill FROM m""")
def regression_metrics(spark, sf):
    own = ordered.previous(V.pairs(spark, sf), F.floor(F.col("l_orderkey") / 4096), ["l_orderkey", "l_linenumber", "y_true", "y_pred"], "y_true", "before")
    return verify.regression(own, "y_true", "y_pred", before="before")


_HOLES = f"{V.PAIRS}, holes AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN NULL ELSE y_true END AS y_true, CASE WHEN l_linenumber = 5 THEN NULL ELSE y_pred END AS y_pred FROM pairs)"


@query(f"""WITH {_HOLES}, p AS (SELECT *, y_true - lag(y_true) OVER (ORDER BY l_orderkey, l_linenumber, y_true, y_pred) AS d FROM holes WHERE y_true IS NOT NULL AND y_pred IS NOT NULL), m AS (SELECT {_REG}, count(*) AS n, sqrt(avg(d * d)) AS ref FROM p)
SELECT round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mbe, 6) AS mbe, round(r2, 6) AS r2, n, round(1 - rmse / (ref + 1e-9), 6) AS skill FROM m""")
def regression_metrics_missing(spark, sf):
    """Pairs with missing values: they are left out before the row before is looked for."""
    line = F.col("l_linenumber")
    holes = V.pairs(spark, sf).withColumns({"y_true": F.when(line != 2, F.col("y_true")), "y_pred": F.when(line != 5, F.col("y_pred"))})
    own = ordered.previous(verify.complete(holes, "y_true", "y_pred"), F.floor(F.col("l_orderkey") / 4096), ["l_orderkey", "l_linenumber", "y_true", "y_pred"], "y_true", "before")
    return verify.regression(own, "y_true", "y_pred", before="before")


def _suite_sql(pred: str) -> str:
    return f"""WITH {V.GRID}, f AS (SELECT station_id, t, s4 AS y_true, {pred} AS y_pred FROM grid), p AS (SELECT *, y_true - lag(y_true) OVER (ORDER BY station_id, t) AS d FROM f WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
m AS (SELECT {_REG}, count(*) AS n, sqrt(avg(d * d)) AS ref FROM p), lv AS (SELECT * FROM (VALUES ('watch', 0.3), ('warning', 0.4), ('severe', 0.7), ('beyond', 1.5)) v(level, thr)),
c AS (SELECT level, count(*) FILTER (WHERE y_true >= thr AND y_pred >= thr) AS tp, count(*) FILTER (WHERE y_true < thr AND y_pred >= thr) AS fp, count(*) FILTER (WHERE y_true >= thr AND y_pred < thr) AS fn FROM p, lv GROUP BY 1),
r AS (SELECT level, y_true >= thr AS pos, rank() OVER (PARTITION BY level ORDER BY y_pred) + (count(*) OVER (PARTITION BY level, y_pred) - 1) / 2 AS rk FROM p, lv),
u AS (SELECT level, (sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2) / nullif(count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos), 0) AS auc FROM r GROUP BY 1),
k AS (SELECT level, tp + fn AS n_events, CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fn > 0 THEN coalesce(tp / nullif(tp + fp, 0), 0) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fn > 0 THEN tp / (tp + fn + 1e-9) END AS pod, CASE WHEN tp + fn > 0 THEN fp / (tp + fp + 1e-9) END AS far, CASE WHEN tp + fn > 0 THEN tp / (tp + fp + fn + 1e-9) END AS csi, auc FROM c JOIN u USING (level)),
s AS (SELECT station_id, t, coalesce(y_true >= 0.4, false) AS onn, y_pred AS pred, row_number() OVER (PARTITION BY station_id ORDER BY t) AS i FROM f),
o AS (SELECT a.station_id, a.i FROM s a JOIN s b ON a.station_id = b.station_id AND b.i = a.i - 1 WHERE a.onn AND NOT b.onn),
l AS (SELECT o.station_id, o.i, max(o.i - q.i) * 60 AS lead FROM o LEFT JOIN s q ON q.station_id = o.station_id AND q.i BETWEEN o.i - 3 AND o.i - 1 AND q.pred >= 0.4 GROUP BY 1, 2),
g AS (SELECT coalesce(avg(lead), 0) AS mean_lead, coalesce(quantile_cont(lead::DOUBLE, 0.5), 0) AS median_lead, count(lead) AS n_leads, count(*) AS n_events FROM l), z AS (SELECT (SELECT f1 FROM k WHERE level = 'warning') AS w, (SELECT f1 FROM k WHERE level = 'severe') AS v),
x AS (SELECT 'regression' AS section, '' AS level, unnest(['mae', 'rmse', 'mbe', 'r2', 'n', 'skill']) AS metric, unnest([mae, rmse, mbe, r2, n::DOUBLE, 1 - rmse / (ref + 1e-9)]) AS value FROM m
UNION ALL SELECT 'events', level, unnest(['n_events', 'f1', 'precision', 'recall', 'pod', 'far', 'csi', 'auc']), unnest([n_events::DOUBLE, f1, precision, recall, pod, far, csi, auc]) FROM k
UNION ALL SELECT 'lead_time', '', unnest(['mean_lead', 'median_lead', 'n_leads', 'n_events']), unnest([mean_lead, median_lead, n_leads::DOUBLE, n_events::DOUBLE]) FROM g
UNION ALL SELECT 'targets', '', unnest(['mae', 'rmse', 'f1_warning', 'f1_severe']), unnest([(mae < 0.08)::INT::DOUBLE, (rmse < 0.12)::INT::DOUBLE, (w > 0.85)::INT::DOUBLE, (v > 0.8)::INT::DOUBLE]) FROM m, z)
SELECT section, level, metric, round(value, 6) AS value FROM x"""


_HOUR_BEFORE = "lag(s4) OVER (PARTITION BY station_id ORDER BY t)"


def _suite(spark, sf, pred) -> DataFrame:
    from pyspark.sql import Window

    own = V.grid(spark, sf).select("station_id", "t", F.col("s4").alias("y_true"), pred(F.lag("s4").over(Window.partitionBy("station_id").orderBy("t"))).alias("y_pred"))
    day = F.col("station_id") * 1_000_000 + F.unix_date(F.to_date("t"))
    before = ordered.previous(verify.complete(own, "y_true", "y_pred"), day, ["station_id", "t"], "y_true", "before")
    levels = events.level_table({"watch": 0.3, "warning": 0.4, "severe": 0.7, "beyond": 1.5})
    return verify.suite(own.join(before.select("station_id", "t", "before"), ["station_id", "t"], "left"), "y_true", "y_pred", "before", "t", ["station_id"], levels, 0.4, 3, 60)


@query(_suite_sql(_HOUR_BEFORE))
def validation_suite(spark, sf):
    """Forecasts of the value an hour before, validated as a whole; one level that the truth never reaches."""
    return _suite(spark, sf, lambda before: before)


@query(_suite_sql(f"CASE WHEN {_HOUR_BEFORE} IS NOT NULL THEN greatest(0, least(1, 3 * {_HOUR_BEFORE} - 0.8)) END"))
def validation_suite_clipped(spark, sf):
    """Forecasts between -0.8 and 2.2, which count as 0 to 1."""
    return _suite(spark, sf, lambda before: 3 * before - 0.8)


@query(f"""WITH {V.PAIRS}, c AS (SELECT level, count(*) FILTER (WHERE y_true >= thr AND y_pred >= thr) AS tp, count(*) FILTER (WHERE y_true < thr AND y_pred >= thr) AS fp, count(*) FILTER (WHERE y_true >= thr AND y_pred < thr) AS fn FROM pairs, (VALUES ('watch', 0.3), ('warning', 0.4), ('severe', 0.7)) v(level, thr) GROUP BY 1)
SELECT level, tp + fn AS n_events, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fn + 1e-9), 6) AS pod, round(fp / (tp + fp + 1e-9), 6) AS far, round(tp / (tp + fp + fn + 1e-9), 6) AS csi FROM c""")
def event_metrics(spark, sf):
    return verify.contingency(V.pairs(spark, sf), "y_true", "y_pred", events.level_table())


@query(f"""WITH {V.PAIRS}, r AS (SELECT y_true >= 0.7 AS pos, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2 AS rk FROM pairs)
SELECT round((sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM r""")
def auc(spark, sf):
    return verify.auc(V.pairs(spark, sf), "y_true", "y_pred", 0.7)


@query(f"""WITH {V.GRID}, s AS (SELECT station_id, t, coalesce(s4 >= 0.4, false) AS onn, lead(s4) OVER (PARTITION BY station_id ORDER BY t) AS pred, row_number() OVER (PARTITION BY station_id ORDER BY t) AS i FROM grid),
o AS (SELECT a.station_id, a.i FROM s a JOIN s b ON a.station_id = b.station_id AND b.i = a.i - 1 WHERE a.onn AND NOT b.onn),
l AS (SELECT o.station_id, o.i, max(o.i - p.i) * 60 AS lead FROM o LEFT JOIN s p ON p.station_id = o.station_id AND p.i BETWEEN o.i - 3 AND o.i - 1 AND p.pred >= 0.4 GROUP BY 1, 2)
SELECT round(coalesce(avg(lead), 0), 6) AS mean_lead, round(coalesce(quantile_cont(lead::DOUBLE, 0.5), 0), 6) AS median_lead, count(lead) AS n_leads, count(*) AS n_events FROM l""")
def lead_time(spark, sf):
    from pyspark.sql import Window

    own = V.grid(spark, sf).withColumn("pred", F.lead("s4").over(Window.partitionBy("station_id").orderBy("t")))
    return verify.lead_times(own, "s4", "pred", "t", ["station_id"], 0.4, 3, 60)


@query(f"WITH {V.GRID} SELECT station_id, t, k AS forecast_step, k * 60 AS lead_time_min, round(s4, 6) AS s4_forecast FROM grid, (SELECT unnest(range(1, 7)) AS k)")
def persistence_forecast(spark, sf):
    return forecast.persistence(V.grid(spark, sf), "s4", 6, 60).select("station_id", "t", "forecast_step", "lead_time_min", "s4_forecast")


_LEADS = f"{V.GRID}, num AS (SELECT station_id, s4, row_number() OVER (PARTITION BY station_id ORDER BY t) AS i FROM grid), p AS (SELECT k AS step, b.s4 AS y_true, a.s4 AS y_pred FROM num a, (SELECT unnest(range(1, 7)) AS k), num b WHERE b.station_id = a.station_id AND b.i = a.i + k AND a.s4 IS NOT NULL AND b.s4 IS NOT NULL)"
_PERS = f"{_LEADS}, m AS (SELECT step, {_REG}, count(*) AS n, coalesce(2 * count(*) FILTER (WHERE y_true >= 0.4 AND y_pred >= 0.4) / nullif(2 * count(*) FILTER (WHERE y_true >= 0.4 AND y_pred >= 0.4) + count(*) FILTER (WHERE (y_true >= 0.4) <> (y_pred >= 0.4)), 0), 0) AS f1_warning FROM p GROUP BY 1)"


def _persistence(spark, sf):
    rows = forecast.pairs_at_leads(V.grid(spark, sf), "s4", "t", ["station_id"], 6)
    f1 = verify.contingency(rows, "y_true", "y_pred", events.level_table({"warning": 0.4}), ["step"])
    return verify.regression(rows, "y_true", "y_pred", ["step"]).join(f1.select("step", F.col("f1").alias("f1_warning")), "step")


@query(f"WITH {_PERS} SELECT step, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(f1_warning, 6) AS f1_warning, n FROM m")
def persistence_eval(spark, sf):
    return _persistence(spark, sf).drop("mbe")


@query(f"WITH {_PERS} SELECT step, step * 60 AS lead_time_min, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(f1_warning, 6) AS f1_warning FROM m UNION ALL SELECT NULL, NULL, round(avg(mae), 6), round(avg(rmse), 6), round(avg(r2), 6), round(avg(f1_warning), 6) FROM m")
def persistence_summary(spark, sf):
    """Each lead, and the mean over the leads, whose step is null."""
    return forecast.lead_summary(_persistence(spark, sf), "step", ["mae", "rmse", "r2", "f1_warning"], 60)


@query(f"WITH {_PERS}, {V.PAIRS}, a AS (SELECT sqrt(avg((y_pred - y_true) ** 2)) AS rmse FROM pairs) SELECT m.step, round(1 - a.rmse / nullif(m.rmse, 0), 6) AS skill FROM m, a")
def skill_score(spark, sf):
    model = verify.regression(V.pairs(spark, sf), "y_true", "y_pred").select(F.col("rmse").alias("own"))
    return _persistence(spark, sf).crossJoin(F.broadcast(model)).select("step", verify.skill(F.col("own"), F.col("rmse")).alias("skill"))


@query(f"WITH {V.PAIRS} SELECT round(0.7 * avg((y_pred - y_true) ** 2) + 0.3 * avg(abs(y_pred - y_true)), 6) AS loss FROM pairs")
def combined_loss(spark, sf):
    return V.pairs(spark, sf).agg(verify.combined_loss(F.col("y_true"), F.col("y_pred")).alias("loss"))


@query(f"WITH {V.PAIRS} SELECT round(avg((1 + abs(y_pred - y_true)) ** 2 * CASE WHEN y_true >= 0.7 THEN 3 ELSE 1 END * (y_pred - y_true) ** 2), 6) AS loss FROM pairs")
def focal_loss(spark, sf):
    return V.pairs(spark, sf).agg(verify.focal_loss(F.col("y_true"), F.col("y_pred")).alias("loss"))


_F1 = "2 * count(*) FILTER (WHERE y_true >= {0} AND y_pred >= {0}) / nullif(2 * count(*) FILTER (WHERE y_true >= {0} AND y_pred >= {0}) + count(*) FILTER (WHERE (y_true >= {0}) <> (y_pred >= {0})), 0)"


@query(f"""WITH {V.PAIRS}, m AS (SELECT {_REG}, {_F1.format(0.4)} AS f4, {_F1.format(0.7)} AS f7 FROM pairs)
SELECT 'mae' AS metric, round(mae, 6) AS value, 0.08::DOUBLE AS target, mae < 0.08 AS passed FROM m UNION ALL SELECT 'rmse', round(rmse, 6), 0.12, rmse < 0.12 FROM m UNION ALL SELECT 'f1_warning', round(f4, 6), 0.85, f4 > 0.85 FROM m UNION ALL SELECT 'f1_severe', round(f7, 6), 0.8, f7 > 0.8 FROM m""")
def target_compliance(spark, sf):
    p = V.pairs(spark, sf)
    f1 = verify.contingency(p, "y_true", "y_pred", events.level_table()).agg(*[F.max(F.when(F.col("level") == x, F.col("f1"))).alias(f"f1_{x}") for x in ("warning", "severe")])
    return verify.compliance(verify.regression(p, "y_true", "y_pred").crossJoin(F.broadcast(f1)))


# Samples, splits, folds, forecasts


@query("SELECT l_orderkey, round(avg(l_quantity / 50), 6) AS mean, round(stddev_samp(l_quantity / 50), 6) AS std_dropout, round(stddev_pop(l_quantity / 50), 6) AS std_members, count(*) AS n FROM lineitem GROUP BY 1")
def ensemble_stats(spark, sf):
    return forecast.ensemble(V.table(spark, sf, "lineitem").withColumn("v", F.col("l_quantity") / 50), "v", ["l_orderkey"])


@query("WITH f AS (SELECT o_orderstatus, o_custkey % 5 AS fold, avg(o_totalprice / 1000) AS m FROM orders GROUP BY 1, 2) SELECT o_orderstatus, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM f GROUP BY 1")
def fold_agg(spark, sf):
    per_fold = V.table(spark, sf, "orders").groupBy("o_orderstatus", (F.col("o_custkey") % 5).alias("fold")).agg(F.avg(F.col("o_totalprice") / 1000).alias("m"))
    return forecast.ensemble(per_fold, "m", ["o_orderstatus"]).select("o_orderstatus", "mean", F.col("std_members").alias("std"))


@query("SELECT CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN 'train' WHEN ts <= TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def temporal_split(spark, sf):
    at = lambda d: F.expr(f"TIMESTAMP_NTZ'{d} 00:00:00'")
    own = V.events(spark, sf).withColumn("split", forecast.temporal_split(F.col("t"), at("2024-01-20"), at("2024-01-25")))
    return own.groupBy("split").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN i <= floor(0.7 * n) THEN 'train' WHEN i <= floor(0.85 * n) THEN 'val' ELSE 'test' END AS split FROM r")
def fraction_split(spark, sf):
    return forecast.fraction_split(V.events(spark, sf).select("event_id", "t"), F.to_date("t"), [F.col("t"), F.col("event_id")]).select("event_id", "split")


@query(f"""WITH {V.GRID}, num AS (SELECT station_id, t, s4, row_number() OVER (PARTITION BY station_id ORDER BY t) AS i FROM grid)
SELECT a.station_id, a.t, count(*) AS n_x, round(sum(coalesce(b.s4, 0)), 6) AS sum_x, round(coalesce(max(b.s4) FILTER (WHERE b.i = a.i - 1), 0), 6) AS last_x, round(coalesce(any_value(a.s4), 0), 6) AS y, any_value(a.s4 IS NOT NULL) AS mask FROM num a JOIN num b ON b.station_id = a.station_id AND b.i BETWEEN a.i - 12 AND a.i - 1 GROUP BY 1, 2 HAVING count(*) = 12""")
def sliding_windows(spark, sf):
    own = forecast.windows(V.grid(spark, sf), "s4", "t", ["station_id"], 12)
    return own.select("station_id", "t", F.size("x").cast("long").alias("n_x"), F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("sum_x"), F.element_at("x", -1).alias("last_x"), "y", "mask")


@query("""WITH e AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders), s AS (SELECT *, greatest(6, ((year(hi) - year(lo)) * 12 + month(hi) - month(lo)) // 6) AS step FROM e),
f AS (SELECT k AS fold, CAST(lo + to_months(CAST(k * step AS INTEGER)) AS DATE) AS val_start, CAST(lo + to_months(CAST(k * step AS INTEGER)) AS DATE) + INTERVAL '6 months' AS val_end, hi FROM s, (SELECT unnest(range(1, 6)) AS k))
SELECT CAST(fold AS BIGINT) AS fold, val_start, CAST(val_end AS DATE) AS val_end, count(*) FILTER (WHERE o_orderdate < val_start) AS n_train, count(*) FILTER (WHERE o_orderdate >= val_start AND o_orderdate < val_end) AS n_val FROM f, orders WHERE val_end <= hi GROUP BY 1, 2, 3 HAVING n_train > 0 AND n_val > 0""")
def temporal_folds(spark, sf):
    return forecast.temporal_folds(V.table(spark, sf, "orders"), "o_orderdate", 5, 6).withColumn("fold", F.col("fold").cast("long"))


@query(f"WITH {V.STATIONS}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM stations), h AS (SELECT 5 AS hold, 25 AS n) SELECT k AS fold, id, list_contains([(k * hold + j) % n for j in range(0, hold)], p) AS held_out FROM r, h, (SELECT unnest(range(0, 5)) AS k)")
def spatial_folds(spark, sf):
    return forecast.spatial_folds(V.stations(spark, sf), 5, 0.2)


_COEF, _ICPT = [0.05] * 11 + [0.4], 0.02


@query(f"""WITH RECURSIVE {V.GRID}, num AS (SELECT station_id, coalesce(s4, 0) AS s4, row_number() OVER (PARTITION BY station_id ORDER BY t DESC) AS i FROM grid), x0 AS (SELECT station_id, list(s4 ORDER BY i DESC) AS x FROM num WHERE i BETWEEN 2 AND 13 GROUP BY 1 HAVING count(*) = 12),
r AS (SELECT station_id, 0 AS k, x, 0.0::DOUBLE AS p FROM x0 UNION ALL SELECT station_id, k + 1, list_append(x[2:], v), v FROM (SELECT station_id, k, x, greatest(0, least(1, 0.05 * list_sum(x[1:11]) + 0.4 * x[12] + 0.02)) AS v FROM r WHERE k < 12))
SELECT station_id, CAST(k AS BIGINT) AS forecast_step, round(p, 6) AS s4_forecast, round(greatest(0, p - 1.96 * 0.1), 6) AS s4_lower, round(least(1, p + 1.96 * 0.1), 6) AS s4_upper FROM r WHERE k > 0""")
def rollout_linear(spark, sf):
    own = forecast.windows(V.grid(spark, sf), "s4", "t", ["station_id"], 12)
    last = own.groupBy("station_id").agg(F.max_by("x", "t").alias("x"))
    return forecast.rollout(last, "x", _COEF, _ICPT, 12, 0.1)


_LAGGED = f"{V.GRID}, lagged AS (SELECT station_id, t, s4 AS y, lag(s4) OVER (PARTITION BY station_id ORDER BY t) AS x FROM grid)"
_CV = "own AS (SELECT * FROM f WHERE x IS NOT NULL AND y IS NOT NULL), fit AS (SELECT fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM own WHERE NOT held GROUP BY 1), e AS (SELECT fold, slope, intercept, slope * x + intercept - y AS e FROM own JOIN fit USING (fold) WHERE held AND slope IS NOT NULL), cv AS (SELECT fold, slope, intercept, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, count(*) AS n FROM e GROUP BY 1, 2, 3)"


def _lagged(spark, sf):
    from pyspark.sql import Window

    return V.grid(spark, sf).select("station_id", "t", F.col("s4").alias("y"), F.lag("s4").over(Window.partitionBy("station_id").orderBy("t")).alias("x"))


def _weekly(spark, sf):
    """Folds that train on all before a week and are validated in it."""
    plan = F.array(*[F.struct(F.lit(k).cast("long").alias("fold"), F.expr(f"TIMESTAMP_NTZ'2024-01-{8 + 7 * k:02d} 00:00:00'").alias("at")) for k in range(3)])
    return _lagged(spark, sf).select("*", F.inline(plan)).where(F.col("t") < F.expr("at + interval 7 days")).withColumn("held", F.col("t") >= F.col("at"))


_WEEKLY = f"{_LAGGED}, f AS (SELECT *, t >= a AS held FROM lagged, (VALUES (0::BIGINT, TIMESTAMP '2024-01-08'), (1, TIMESTAMP '2024-01-15'), (2, TIMESTAMP '2024-01-22')) v(fold, a) WHERE t < a + INTERVAL '7 days'), {_CV}"


@query(f"WITH {_WEEKLY} SELECT fold, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(mae, 6) AS mae, round(rmse, 6) AS rmse, n FROM cv")
def cv_temporal(spark, sf):
    return forecast.cross_validate(_weekly(spark, sf), "x", "y", "fold", "held")


@query(f"WITH {_WEEKLY} SELECT 'mae' AS metric, round(avg(mae), 6) AS mean, round(stddev_pop(mae), 6) AS std FROM cv UNION ALL SELECT 'rmse', round(avg(rmse), 6), round(stddev_pop(rmse), 6) FROM cv")
def cv_summary(spark, sf):
    return forecast.over_folds(forecast.cross_validate(_weekly(spark, sf), "x", "y", "fold", "held"), ["mae", "rmse"])


@query(f"WITH {_LAGGED}, f AS (SELECT k AS fold, station_id % 5 = k AS held, x, y FROM lagged, (SELECT unnest(range(0, 5)) AS k)), {_CV} SELECT fold, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(mae, 6) AS mae, round(rmse, 6) AS rmse, n FROM cv")
def cv_spatial(spark, sf):
    """Folds that hold every fifth station out."""
    folds = _lagged(spark, sf).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("held", F.col("station_id") % 5 == F.col("fold"))
    return forecast.cross_validate(folds, "x", "y", "fold", "held")


@query(f"""WITH RECURSIVE {V.GRID}, num AS (SELECT station_id, s4 IS NOT NULL AS mask, coalesce(s4, 0) AS y, lag(coalesce(s4, 0)) OVER (PARTITION BY station_id ORDER BY t) AS x, row_number() OVER (PARTITION BY station_id ORDER BY t DESC) AS i FROM grid),
fit AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM num WHERE mask AND x IS NOT NULL), r AS (SELECT station_id, 0::BIGINT AS forecast_step, x AS v FROM num WHERE i = 1 UNION ALL SELECT station_id, forecast_step + 1, greatest(0, least(1, a * v + b)) FROM r, fit WHERE forecast_step < 12)
SELECT station_id, forecast_step, round(v, 6) AS s4_forecast FROM r WHERE forecast_step > 0""")
def rollout_fitted(spark, sf):
    """A scorer fitted on all samples of one step, rolled out from each station's last sample."""
    own = forecast.windows(V.grid(spark, sf), "s4", "t", ["station_id"], 1)
    last = own.groupBy("station_id").agg(F.max_by("x", "t").alias("x"))
    return forecast.rollout(last, "x", *forecast.fit_linear(own, "x", "y", "mask"), 12).select("station_id", "forecast_step", "s4_forecast")


@query(f"""WITH {V.GRID}, lagged AS (SELECT station_id, t, coalesce(s4, 0) AS y, coalesce(lag(s4, 2) OVER w, 0) AS a, coalesce(lag(s4) OVER w, 0) AS b, row_number() OVER w AS i FROM grid WINDOW w AS (PARTITION BY station_id ORDER BY t)),
f AS (SELECT k AS fold, station_id % 5 = k AS held, a, b, y FROM lagged, (SELECT unnest(range(0, 5)) AS k) WHERE i > 2),
s AS (SELECT fold, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bee, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM f WHERE NOT held GROUP BY 1),
c AS (SELECT fold, (ay * bb - bee * ab) / (aa * bb - ab * ab) AS ca, (bee * aa - ay * ab) / (aa * bb - ab * ab) AS cb, ma, mb, my FROM s), m AS (SELECT fold, ca, cb, my - ca * ma - cb * mb AS icpt FROM c),
e AS (SELECT fold, ca, cb, icpt, y, ca * a + cb * b + icpt - y AS e FROM f JOIN m USING (fold) WHERE held)
SELECT fold, round(ca, 6) AS second_lag, round(cb, 6) AS first_lag, round(icpt, 6) AS intercept, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2, count(*) AS n FROM e GROUP BY fold, ca, cb, icpt""")
def cv_two_lags(spark, sf):
    """A scorer of two features, fitted for five folds at once, each of which holds every fifth station out."""
    own = forecast.windows(V.grid(spark, sf), "s4", "t", ["station_id"], 2)
    folds = own.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("held", F.col("station_id") % 5 == F.col("fold"))
    out = regress.cross_validate(folds, "x", 2, "y", "fold", "held")
    return out.select("fold", F.col("coefficients")[0].alias("second_lag"), F.col("coefficients")[1].alias("first_lag"), "intercept", "mae", "rmse", "r2", "n")


_DRAWS = " + ".join(f"(u >= {d!r})::BIGINT" for d in regress.DRAWS)


@query(f"""WITH RECURSIVE {V.GRID}, num AS (SELECT station_id, t, s4 IS NOT NULL AS mask, coalesce(s4, 0) AS y, lag(coalesce(s4, 0)) OVER (PARTITION BY station_id ORDER BY t) AS x, row_number() OVER (PARTITION BY station_id ORDER BY t DESC) AS i FROM grid),
u AS (SELECT member, x, y, CAST('0x' || md5('7:' || member || ':' || station_id || ':' || epoch_us(t))[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u FROM num, (SELECT unnest(range(0, 8)) AS member) WHERE mask AND x IS NOT NULL),
w AS (SELECT member, x, y, {_DRAWS} AS w FROM u), g AS (SELECT member, sum(w)::DOUBLE AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w GROUP BY 1),
fit AS (SELECT member, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS a, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS b FROM g),
r AS (SELECT station_id, member, 0::BIGINT AS forecast_step, x AS v FROM num, fit WHERE i = 1 UNION ALL SELECT station_id, r.member, forecast_step + 1, greatest(0, least(1, a * v + b)) FROM r JOIN fit ON fit.member = r.member WHERE forecast_step < 12),
m AS (SELECT station_id, forecast_step, avg(v) AS f, stddev_pop(v) AS std FROM r WHERE forecast_step > 0 GROUP BY 1, 2)
SELECT station_id, forecast_step, round(f, 6) AS s4_forecast, round(std, 6) AS std, round(greatest(0, least(1, f - 1.96 * std)), 6) AS s4_lower, round(greatest(0, least(1, f + 1.96 * std)), 6) AS s4_upper FROM m""")
def rollout_ensemble(spark, sf):
    """Eight scorers fitted on bootstrap draws of all samples, rolled out from each station's last one; bounds from the members' spread."""
    own = forecast.windows(V.grid(spark, sf), "s4", "t", ["station_id"], 1)
    drawn = regress.bootstrap(own.where("mask"), [F.col("station_id"), X.micros("t")], 8, seed=7)
    models = regress.fit(drawn, ["member"], "x", 1, "y", F.col("draws"))
    last = own.groupBy("station_id").agg(F.max_by("x", "t").alias("x"))
    return regress.rollout_ensemble(last, models, "x", ["station_id"], 12)


@query(f"""WITH {_EVENTS}, act AS (SELECT * FROM ev WHERE "end" >= TIMESTAMP '2024-01-15') SELECT format('EVT-{{:05d}}', event_id) AS code, station_id, upper(act.level) AS level, round(peak_s4, 4) AS peak_s4 FROM act JOIN lv ON lv.level = act.level ORDER BY rk DESC, round(peak_s4, 4) DESC, code LIMIT 5""")
def first_alerts(spark, sf):
    rows = events.alerts(_events(spark, sf), F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'"), "station_id")
    return events.first_alerts(rows, 5).select("code", "station_id", "level", "peak_s4")


# Sources


# Feeds are made up from whole tables, a text a day, and read back; the SQL takes the values from the tables.


def _daily(df: DataFrame, body) -> DataFrame:
    return df.groupBy(F.to_date("t").alias("d")).agg(body.alias("body"))


@query(f"WITH {V.WIND} SELECT t AS timestamp, round(CASE WHEN event_id % 7 <> 0 THEN bz END, 6) AS bz, round(CASE WHEN event_id % 5 <> 0 THEN v_sw END, 6) AS bt FROM wind")
def dscovr_json_parse(spark, sf):
    some = lambda c, every: F.when(F.col("event_id") % every == 0, "-999.9").otherwise(F.col(c).cast("string"))
    row = F.array(F.col("t").cast("string"), F.lit("1"), F.lit("2"), some("bz", 7), F.lit("0"), F.lit("0"), some("v_sw", 5))
    head = F.array(F.array(*[F.lit(x) for x in ("time_tag", "bx", "by", "bz", "lon", "lat", "bt")]))
    return parsers.array_mag(_daily(V.wind(spark, sf), F.to_json(F.concat(head, F.collect_list(row)))), "body")


@query(f"WITH {V.WIND} SELECT t AS timestamp, round(CASE WHEN event_id % 5 <> 0 THEN n_p END, 6) AS n_p, round(CASE WHEN event_id % 7 <> 0 THEN v_sw END, 6) AS v_sw, round(CASE WHEN event_id % 3 <> 0 THEN 1000 * n_p END, 6) AS t_p FROM wind")
def plasma_json_parse(spark, sf):
    some = lambda c, every, mark: F.when(F.col("event_id") % every == 0, mark).otherwise(c.cast("string"))
    row = F.array(F.col("t").cast("string"), some(F.col("n_p"), 5, "-9999.9"), some(F.col("v_sw"), 7, "-9999.9"), some(1000 * F.col("n_p"), 3, "-1.00e+05"))
    head = F.array(F.array(*[F.lit(x) for x in ("time_tag", "density", "speed", "temperature")]))
    return parsers.array_plasma(_daily(V.wind(spark, sf), F.to_json(F.concat(head, F.collect_list(row)))), "body")


@query(f"WITH {V.WIND} SELECT t AS timestamp, round(CASE WHEN event_id % 7 <> 0 THEN bz END, 6) AS bz, round(CASE WHEN event_id % 5 <> 0 THEN v_sw END, 6) AS bt FROM wind WHERE event_id % 11 <> 0")
def ace_json_parse(spark, sf):
    at = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("t").cast("string"))
    row = F.struct(at.alias("time_tag"), F.when(F.col("event_id") % 7 != 0, F.col("bz").cast("string")).alias("bz_gsm"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("v_sw").cast("string")).alias("bt"))
    return parsers.object_rows(_daily(V.wind(spark, sf), F.to_json(F.collect_list(row))), "body", {"bz": "bz_gsm", "bt": "bt"})


@query(f"WITH {V.AURORA} SELECT round(avg(hp_north) FILTER (WHERE event_id % 3 <> 0), 6) AS hp_north, round(0.9 * avg(hp_north) FILTER (WHERE event_id % 3 <> 0), 6) AS hp_south FROM aur GROUP BY CAST(t AS DATE)")
def aurora_json_mean(spark, sf):
    row = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.col("hp_north")))
    return parsers.hemispheric_power(_daily(V.aurora(spark, sf), F.to_json(F.struct(F.collect_list(row).alias("coordinates")))), "body")


# A day has a line for each of two halves of the stations, so dates repeat; counts that end in 3 are unreadable.
_BINS = "c AS (SELECT CAST(t AS DATE) AS d, station_id % 2 AS half, i, count(*) FILTER (WHERE hour(t) // {w} = i) AS n FROM obs, (SELECT unnest(range(0, {k})) AS i) GROUP BY 1, 2, 3), b AS (SELECT d, half, min(i) FILTER (WHERE n % 10 = 3) AS bad FROM c GROUP BY 1, 2)"


def _line(spark, sf, width: int, head: str, count) -> DataFrame:
    at = F.floor(F.hour("t") / width)
    counts = F.array_join(F.array(*[count(F.count_if(at == i)) for i in range(24 // width)]), " ")
    return V.obs(spark, sf).groupBy(F.to_date("t").alias("d"), (F.col("station_id") % 2).alias("half")).agg(counts.alias("v")).select("d", F.concat_ws(" ", F.date_format("d", head), "v").alias("line"))


@query(f"WITH {V.OBS}, {_BINS.format(w=3, k=8)} SELECT CAST(d AS TIMESTAMP) + to_hours(CAST(3 * i AS INTEGER)) AS timestamp, round(n / 10, 6) AS kp FROM c JOIN b USING (d, half) WHERE (bad IS NULL OR i < bad) AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")
def kp_text_parse(spark, sf):
    count = lambda n: F.when(n % 10 == 3, "x").otherwise(n.cast("string"))
    lines = _line(spark, sf, 3, "yyyy MM dd", count)
    notes = lines.select("d", F.lit("# a comment of more than eleven words that is no line of values at all").alias("line"))
    return parsers.kp_lines(lines.unionByName(notes), "line", "2024-01-05", "2024-01-25")


@query(f"WITH {V.OBS}, {_BINS.format(w=1, k=24)} SELECT CAST(d AS TIMESTAMP) + to_hours(CAST(i AS INTEGER)) AS timestamp, CASE WHEN n > 0 THEN CAST(-n AS DOUBLE) END AS dst FROM c JOIN b USING (d, half) WHERE bad IS NULL")
def dst_html_parse(spark, sf):
    count = lambda n: F.when(n % 10 == 3, "1.5").when(n == 0, "9999").otherwise((-n).cast("string"))
    lines = _line(spark, sf, 1, "'Dst' MMM d yyyy", count)
    # A page a week, a block a line, and lines outside of any block.
    pages = lines.groupBy(F.date_trunc("week", "d").alias("w")).agg(F.concat(F.lit("<html>Dst Jan 1 2000 1 2"), F.array_join(F.collect_list(F.concat(F.lit("<PRE class=x>\nhead\n"), "line", F.lit("\n</PRE>"))), "\n"), F.lit("</html>")).alias("page"))
    return parsers.dst_block(pages, "page")


# Twelve stations as three latitudes by four longitudes of a map a day; no count is a missing value.
@query(f"WITH {V.OBS}, c AS (SELECT CAST(t AS DATE) AS d, s, count(*) FILTER (WHERE station_id = s) AS n FROM obs, (SELECT unnest(range(0, 12)) AS s) GROUP BY 1, 2) SELECT CAST(d AS TIMESTAMP) AS epoch, CAST(20 - 20 * (s // 4) AS DOUBLE) AS lat, CAST(-30 + 30 * (s % 4) AS DOUBLE) AS lon, CASE WHEN n > 0 THEN round(n / 10, 6) END AS tec FROM c")
def ionex_maps(spark, sf):
    tagged = lambda text, tag: F.concat(F.rpad(text, 60, " "), F.lit(tag))
    # Hundredths, so that no count is written as 9999; numbers have a blank between them, however long they are.
    n = lambda s: F.when(F.count_if(F.col("station_id") == s) == 0, F.lit(9999)).otherwise(10 * F.count_if(F.col("station_id") == s)).cast("string")
    lines = [tagged(F.lit("    -2"), "EXPONENT"), tagged(F.lit("     1"), "START OF TEC MAP"), tagged(F.date_format(F.first("d"), "  yyyy     M     d     0     0     0"), "EPOCH OF CURRENT MAP")]
    for i, lat in enumerate((20.0, 0.0, -20.0)):
        lines += [tagged(F.lit(f"  {lat:6.1f}{-30.0:6.1f}{60.0:6.1f}{30.0:6.1f}{450.0:6.1f}"), "LAT/LON1/LON2/DLON/H"), F.concat_ws(" ", *[n(4 * i + j) for j in range(4)])]
    lines.append(tagged(F.lit("     1"), "END OF TEC MAP"))
    files = V.obs(spark, sf).withColumn("d", F.to_date("t")).groupBy(F.col("d").alias("day")).agg(F.concat_ws("\n", *lines).alias("file"))
    return parsers.ionosphere_maps(files, "file")


@query(f"""WITH {V.MAPS}, u AS (SELECT *, 0 AS new FROM maps UNION ALL SELECT lat, lon + 3, epoch, tec + 1, 1 FROM maps) SELECT lat, lon, epoch, round(arg_min(tec, new), 6) AS tec FROM u GROUP BY 1, 2, 3""")
def merge_dedupe_keep_first(spark, sf):
    """All maps, and the same moved by three, of which some meet others' keys."""
    maps = V.maps(spark, sf)
    return tables.merge_first(maps, maps.withColumns({"lon": F.col("lon") + 3, "tec": F.col("tec") + 1}), ["lat", "lon", "epoch"], ["tec"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def manifest_anti_join(spark, sf):
    done = V.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.pending(V.table(spark, sf, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query(f"WITH {V.STATIONS} SELECT id, lat, lon, country FROM stations WHERE lat >= -10 AND lat <= 10 AND lon >= 0 AND lon <= 40")
def bbox_filter(spark, sf):
    return parsers.in_region(V.stations(spark, sf), (-10.0, 10.0), (0.0, 40.0))


@query(f"WITH {V.OBS}, {V.STATIONS} SELECT event_id, lat, lon, country, id IS NOT NULL AS found FROM obs LEFT JOIN stations ON id = station_id * 3")
def station_lookup(spark, sf):
    """Every observation with its station's record; numbers that no station has find none."""
    own = V.obs(spark, sf).select("event_id", (F.col("station_id") * 3).alias("station"))
    return tables.lookup(own, V.stations(spark, sf), "station", "id", ["lat", "lon", "country"], "found").select("event_id", "lat", "lon", "country", "found")


_NAMED = "SELECT o_orderkey, o_orderdate, o_orderkey % 7 AS k, CASE WHEN o_orderkey % 7 = 6 THEN 'other_' || o_orderkey || '.txt' ELSE 'st' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') || '0000_' || year(o_orderdate) || lpad(CAST(dayofyear(o_orderdate) AS VARCHAR), 3, '0') || '0000_01D_30S_MO.crx' || CASE WHEN o_orderkey % 7 > 3 THEN '.gz' ELSE '' END END AS name FROM orders"


@query(f"WITH n AS ({_NAMED}) SELECT o_orderkey, CASE WHEN k < 6 THEN upper(name[1:4]) END AS station, CASE WHEN k < 6 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN k < 6 THEN '30S' END AS rate, CASE WHEN k < 6 THEN 'crx' END AS format, CASE WHEN k IN (4, 5) THEN 'gz' END AS packed FROM n")
def file_tokens(spark, sf):
    """What the names of daily files say, made from the dates of all orders."""
    k, number = F.col("o_orderkey") % 7, F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0")
    day = F.concat(F.year("o_orderdate"), F.lpad(F.dayofyear("o_orderdate").cast("string"), 3, "0"))
    name = F.when(k == 6, F.concat(F.lit("other_"), "o_orderkey", F.lit(".txt"))).otherwise(F.concat(F.lit("/raw/st"), number, F.lit("0000_"), day, F.lit("0000_01D_30S_MO.crx"), F.when(k > 3, ".gz").otherwise("")))
    made = X.file_tokens(name)
    return V.table(spark, sf, "orders").select("o_orderkey", *[made[c].alias(c) for c in ("station", "day", "rate", "format", "packed")])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE json_extract_string(props, '$.k') END AS k FROM events")
def nested_default(spark, sf):
    """A value two maps down, of maps that lack it for every third row."""
    inner = F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("k"), X.json_nested(F.col("props"), "k")))
    return V.events(spark, sf).select("event_id", X.nested(F.create_map(F.lit("props"), inner), "props", "k", default=F.lit("none")).alias("k"))


@query(f"WITH {V.WIND} SELECT event_id, round(CASE WHEN bz < 0 THEN 400 * -bz ELSE 0 END, 6) AS epsilon, round(-400 * bz / 1000, 6) AS ey, 5.0 * 400 * 400::DOUBLE AS beta_sw FROM wind")
def coupling_absent(spark, sf):
    """Coupling of a table that has the field alone."""
    made = X.coupling(F.col("bz"))
    return V.wind(spark, sf).select("event_id", *[made[c].alias(c) for c in ("epsilon", "ey", "beta_sw")])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stations had which events, and where: resample, drop outliers, fill short gaps, detect, locate."""
    own = clean.outliers(V.grid(spark, sf_dir), ["s4"], ["station_id"], 3.0)
    own = clean.fill_gaps(own, "t", ["s4"], ["station_id"], 2)
    found = events.detect(own, "s4", "t", "station_id", 60, 60)
    return events.map_rows(found, V.stations(spark, sf_dir), "station_id")
