"""Small cases worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronolith.functions import expressions as X
from chronolith.operators import asof, clean, events, features, forecast, graph, verify
from chronolith.sources import parsers, tables
from chronolith.streaming import series

N = None
T0 = dt.datetime(2024, 1, 1)


def frame(spark, values, minutes=30, name="v"):
    return spark.createDataFrame([(1, T0 + dt.timedelta(minutes=minutes * i), v) for i, v in enumerate(values)], f"k long, t timestamp_ntz, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


@pytest.mark.parametrize("limit,want", [(2, [N, 1, 1, 1, 2, 3, N, 5, 6, 7, 7, 7, N]), (4, [1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 7, 7, 7])])
def test_gap_fill(spark, limit, want):
    df = frame(spark, [N, N, N, 1.0, N, N, N, N, N, 7.0, N, N, N])
    assert column(clean.fill_gaps(df, "t", ["v"], ["k"], limit), "v") == want


def test_gap_fill_by_time_and_strict(spark):
    df = frame(spark, [0.0, N, 2.0, N, N, N, 6.0, N])
    assert column(clean.fill_gaps(df, "t", ["v"], ["k"], 2, strict=True, by_time=True), "v") == [0, 1, 2, N, N, N, 6, N]


def test_densify(spark):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=10), 1.0), (1, T0 + dt.timedelta(minutes=100), 2.0)], "k long, t timestamp_ntz, v double")
    assert column(clean.resample(df, "t", "30 minutes", {"v": "max"}, ["k"]), "v") == [1, N, N, 2]
    assert clean.resample(df.limit(0), "t", "30 minutes", {"v": "first"}, ["k"]).count() == 0


def test_quartiles(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 10.0])
    assert column(clean.outliers(df, ["v"], ["k"], 1.0), "v") == [1, 2, 3, N]
    assert column(clean.outliers(df, ["v"], [], 1.0, "clip"), "v") == [1, 2, 3, 7.75]


def test_scaler(spark):
    df = spark.createDataFrame([(0.5, -15.0, 4.5, -100.0, 3.0), (N, 30.0, 1.0, -90.0, 3.0)], "s4 double, bz double, kp double, dst double, c double")
    names = ["s4", "bz", "kp", "dst", "c"]
    params = clean.fit_scaler(df, names, X.BOUNDS)
    assert [tuple(r) for r in clean.scale(df, params, names).select("s4", "bz", "kp", "dst", "c").collect()][0] == (0.5, 0.5, 0.5, 0.5, 0)
    assert clean.scale(df, params, names).where("bz = 1 and s4 is null").count() == 1


def test_asof_ties(spark):
    left = spark.createDataFrame([(T0 + dt.timedelta(hours=1), 7)], "t timestamp_ntz, id long")
    right = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), s, v) for m, s, v in ((30, 1, 1.0), (30, 2, 2.0), (90, 3, 3.0), (90, 4, 4.0))], "t timestamp_ntz, s long, v double")
    for minutes, want in ((30, 2.0), (29, N)):
        assert asof.asof_join(left, right, "t", ["v"], minutes * 60_000_000, sequence="s").first()["v"] == want
    assert asof.asof_join(left, right.limit(0), "t", ["v"], 60_000_000).first()["v"] is None
    assert asof.asof_join(left.limit(0), right, "t", ["v"], 60_000_000).count() == 0


def test_range_frame(spark):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=s), v) for s, v in ((0, 1.0), (30, 3.0), (60, 5.0))], "k long, t timestamp_ntz, v double")
    got = column(features.range_variation(df, "v", "t", ["k"]), "s4_index")
    assert got[0] is None and got[1:] == pytest.approx([2**0.5 / 2, 2**0.5 / 4])


def test_storm(spark):
    df = frame(spark, [-10.0, -60.0, -80.0, -70.0, -40.0, -15.0], name="dst")
    out = features.storm(df, "dst", "t", ["k"])
    assert column(out, "gradient") == [-50, -35, -5, 20, 27.5, 25]
    assert column(out, "hours_since_onset") == [72, 0, 0.5, 1, 1.5, 2]
    assert column(out, "phase") == [0, 2, 2, 3, 1, 1]
    assert column(df.withColumn("i", X.storm_intensity(F.col("dst"))), "i") == [0, 1, 1, 1, 1, 0]
    assert column(features.rolling_mean(df, "dst", "t", ["k"]), "mean_24h")[-1] == pytest.approx(-45.833333)


def test_events(spark):
    got = events.detect(frame(spark, [0.1, 0.35, 0.45, 0.75, 0.2, 0.3, N, 0.5]), "v", "t", "k").orderBy("event_id").collect()
    assert [(r.event_id, r.level, int((r.onset - T0).seconds / 1800), int((r.end - T0).seconds / 1800), r.peak_s4, round(r.mean_s4, 6), r.duration_min) for r in got] == [
        (1, "severe", 3, 3, 0.75, 0.75, 30), (2, "warning", 2, 3, 0.75, 0.6, 60), (3, "warning", 7, 7, 0.5, 0.5, 30), (4, "watch", 1, 3, 0.75, 0.516667, 90), (5, "watch", 5, 5, 0.3, 0.3, 30), (6, "watch", 7, 7, 0.5, 0.5, 30),
    ]
    quiet = events.detect(frame(spark, [0.1] * 24), "v", "t", "k")
    assert quiet.count() == 0 and "colour" in quiet.columns


def test_calibrate(spark):
    own = spark.range(200).select((F.col("id") / 200).alias("v"))
    assert list(events.calibrate(own, "v").first()) == pytest.approx([0.40, 0.60, 0.95])
    assert list(events.calibrate(own.limit(50), "v").first()) == [0.3, 0.4, 0.7]


def test_distances(spark):
    sites = [("ACCR", 5.6, -0.2)]
    df = spark.createDataFrame([*sites, ("SAME", 5.6, -0.2), ("FAR", 5.6, 40.0)], "id string, lat double, lon double")
    d = graph.distances(df)
    assert d.count() == 6 and d.where("src = 'ACCR' and dst = 'SAME'").first()["dist_km"] == 0
    edges = graph.near(df, 1000.0)
    assert {(r.src, r.dst) for r in edges.collect()} == {("ACCR", "SAME"), ("SAME", "ACCR")}
    assert graph.weights(edges, d, df).count() == 3  # self loops only: stations at one place have no weight


def test_correlation_of_a_constant(spark):
    rows = [(k, T0 + dt.timedelta(hours=i), float(v)) for i in range(5) for k, v in ((1, 3), (2, i), (3, -i))]
    df = spark.createDataFrame(rows, "station_id long, t timestamp_ntz, v double")
    got = {(r.src, r.dst): r["corr"] for r in graph.correlations(df, "v").collect()}
    assert got[1, 2] == 0 and got[2, 3] == pytest.approx(-1)


def test_coupling_and_solar_time(spark):
    one = spark.range(1)
    base = {k: v.alias(k) for k, v in X.coupling(F.lit(-10.0), F.lit(400.0), F.lit(5.0)).items()}
    assert list(one.select(*base.values()).first()) == pytest.approx([4000, 1055.972034, 4, 800000])
    assert one.select(X.coupling(F.lit(-10.0), F.lit(400.0), F.lit(5.0), F.lit(12.0))["newell"]).first()[0] == pytest.approx(872.821776)
    h = X.harmonics(F.expr("TIMESTAMP_NTZ'2024-01-01 20:30:00'"), F.lit(30.0))
    assert list(one.select(h["lt_hour"], h["post_sunset"], h["sin_hour_1"], h["cos_hour_1"]).first()) == pytest.approx([22.5, 0, -0.382683, 0.923880], abs=1e-6)
    assert one.select(X.solar_hour(F.expr("TIMESTAMP_NTZ'2024-01-01 01:00:00'"), F.lit(-30.0))).first()[0] == 23


def test_metrics(spark):
    rows = [(i, y, p) for i, (y, p) in enumerate(zip([0.1, 0.3, 0.5, 0.7, 0.9], [0.15, 0.25, 0.55, 0.65, 0.95]))]
    df = spark.createDataFrame([*rows, (9, None, 1.0)], "i long, y double, p double")
    before = {r[0]: rows[r[0] - 1][1] if r[0] else None for r in rows}
    own = df.join(spark.createDataFrame(list(before.items()), "i long, b double"), "i", "left")
    got = verify.regression(own, "y", "p", before="b").first()
    assert (got.mae, got.rmse, got.mbe, got.r2, got["skill"]) == pytest.approx((0.05, 0.05, 0.01, 0.96875, 0.75))
    assert verify.regression(df.limit(0), "y", "p").count() == 0
    pairs = spark.createDataFrame([(0.2, 0.3), (0.6, 0.5), (0.8, 0.7)], "y double, p double")
    assert pairs.agg(verify.combined_loss(F.col("y"), F.col("p"))).first()[0] == pytest.approx(0.037)
    focal = spark.createDataFrame([(0.8, 0.1), (0.8, 0.1)], "y double, p double").agg(verify.focal_loss(F.col("y"), F.col("p"))).first()[0]
    assert focal > spark.createDataFrame([(0.2, 0.1)], "y double, p double").agg(verify.focal_loss(F.col("y"), F.col("p"))).first()[0]
    ties = spark.createDataFrame([(0.0, 0.1), (0.0, 0.4), (1.0, 0.4), (1.0, 0.8)], "y double, p double")
    assert verify.auc(ties, "y", "p", 0.5).first()[0] == 0.875
    assert verify.auc(ties.where("y = 1"), "y", "p", 0.5).first()[0] is None


def test_lead_time(spark):
    rows = [(1, T0 + dt.timedelta(minutes=30 * i), y, p) for i, (y, p) in enumerate(zip([0.1, 0.1, 0.1, 0.5, 0.6, 0.1, 0.1, 0.5], [0.1, 0.5, 0.1, 0.5, 0.5, 0.1, 0.45, 0.1]))]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, y double, p double")
    assert list(verify.lead_times(df, "y", "p", "t", ["k"], 0.4, 2, 30).first()) == [45, 45, 2, 2]


def test_spatial_folds(spark):
    rows = forecast.spatial_folds(spark.range(15), 5, 0.2).where("held_out").groupBy("fold").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("fold").collect()
    assert [r.ids for r in rows] == [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(5)]


def test_maps_file(spark):
    def line(body, tag):
        return f"{body:<60}{tag}"

    axis = lambda *v: line("  " + "".join(f"{x:6.1f}" for x in v), "LAT/LON1/LON2/DLON/H")
    text = "\n".join([
        line("    -1", "EXPONENT"), line("     1", "START OF TEC MAP"), line("  2024     1     2     0     0     0", "EPOCH OF CURRENT MAP"),
        axis(10.0, -180.0, -170.0, 5.0, 450.0), "   10   20 9999", axis(0.0, 0.0, 10.0, 5.0, 450.0), "    5    6", "    7", axis(-10.0, 0.0, 10.0, 5.0, 450.0), "    5    6", line("     1", "END OF TEC MAP"),
    ])
    df = spark.createDataFrame([(text,), (None,)], "body string")
    got = parsers.ionosphere_maps(df, "body", (-90.0, 90.0), (-180.0, 180.0)).collect()
    first = {r.lon: r.tec for r in got if r.lat == 10.0}
    assert first == {-180.0: 1.0, -175.0: 2.0, -170.0: None}
    assert {r.lon: round(r.tec, 6) for r in got if r.lat == 0.0} == {0.0: 0.5, 5.0: 0.6, 10.0: 0.7}  # values on two lines
    assert {r.lat for r in got} == {10.0, 0.0} and got[0].epoch == dt.datetime(2024, 1, 2)  # a value is missing at -10


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/layer"
    assert tables.read_or_empty(spark, path, "a long, b string").count() == 0
    spark.createDataFrame([(1, "x")], "a long, b string").write.parquet(path)
    old = tables.read_or_empty(spark, path, "a long, b string")
    new = spark.createDataFrame([(1, "y"), (2, "z"), (2, "w")], "a long, b string")
    assert sorted(map(tuple, tables.merge_first(old, new, ["a"], ["b"]).collect())) == [(1, "x"), (2, "w")]
    with pytest.raises(ValueError):
        tables.require(old, ["c"])
    for name, v in (("a1.csv", 1), ("a2.csv", 2)):
        (tmp_path / "csv").mkdir(exist_ok=True)
        (tmp_path / "csv" / name).write_text(f"v\n{v}\n")
    assert [r.v for r in tables.latest_csv(spark, f"file://{tmp_path}/csv", "v long").collect()] == [2]


def test_streams(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(minutes=m), v) for m, v in ((1, 0.2), (20, 0.8), (40, 0.5), (300, 0.1))]
    spark.createDataFrame(rows, "k long, t timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("k long, t timestamp, v double").parquet(f"{tmp_path}/in")
    q = series.resample_stream(source, "t", "30 minutes", "k", "v").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.peak for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0.5, 0.8]


def test_kp_lines_are_read_one_by_one(spark):
    lines = ["2024 01 02 1 2 x 4 5 6 7 8", "2024 01 02 10 20 30 40 50 60 70 80", "2024 01 03 x 2 3 4 5 6 7 8"]
    rows = parsers.kp_lines(spark.createDataFrame([(x,) for x in lines], "body string"), "body", "2024-01-01", "2024-01-05").collect()
    assert len(rows) == 10 and sorted(r.kp for r in rows) == [0.1, 0.2, 1, 2, 3, 4, 5, 6, 7, 8]


def test_dst_blocks(spark):
    good, bad = " ".join(map(str, range(24))), " ".join(["1.5", *map(str, range(23))])
    page = f"<PRE>\nDst Jan 1 2024 {good}\nDst Jan 2 2024 {bad}\n</PRE> Dst Jan 3 2024 {good}\n<pre id=2>Dst Feb 30 2024 {good}\nDst Jan 4 2024 {good.replace('7', '9999', 1)}</pre>"
    rows = parsers.dst_block(spark.createDataFrame([(page,)], "body string"), "body").collect()
    assert len(rows) == 48 and {r.timestamp.day for r in rows} == {1, 4} and sum(r.dst is None for r in rows) == 1


def test_skill_is_masked_first(spark):
    df = spark.createDataFrame([(i, t, 0.9 * i) for i, t in enumerate([1.0, N, 3.0, 4.0])], "i long, y double, p double")
    own = df.select("*", F.lit(0).alias("b"))
    from chronolith.operators import ordered

    before = ordered.previous(verify.complete(own, "y", "p"), F.col("b"), ["i"], "y", "before")
    got = verify.regression(before, "y", "p", before="before").first()
    e = [0 - 1.0, 1.8 - 3, 2.7 - 4]
    assert abs(got.skill - (1 - (sum(x * x for x in e) / 3) ** 0.5 / ((4 + 1) / 2) ** 0.5)) < 1e-6


def test_levels_without_events(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.2, 0.6)], "y double, p double")
    rows = {r.level: r for r in verify.contingency(df, "y", "p", events.level_table()).collect()}
    assert rows["severe"].n_events == 0 and rows["severe"].f1 is None and rows["watch"].recall == 1


def test_quantiles(spark):
    from chronolith.operators import ordered

    rows = [(k, float(v)) for k in (1, 2) for v in [3, 3, 3, -1, 10, 7.5, *range(k * 40)]] + [(3, 5.0), (4, N)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.q for r in ordered.quantiles(df, "v", ["k"], [0.0, 0.25, 0.5, 0.9, 1.0], accuracy=7).collect()}
    want = {r.k: r.q for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.9, 1.0)])).alias("q")).collect()}
    assert set(got) == {1, 2, 3} and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))
    assert ordered.quantiles(df.limit(0), "v", [], [0.5]).count() == 0


def test_near_everywhere(spark):
    import math
    import random

    rng = random.Random(2)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(400, 89.9, 0.0), (401, 89.9, 180.0), (402, 0.0, 179.9), (403, 0.0, -179.9), (404, 0.0, 179.9)]

    def km(a, b):
        (p, q), (r, s) = ((math.radians(x) for x in y[1:]) for y in (a, b))
        return 2 * X.EARTH_KM * math.asin(math.sqrt(min(1, math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))

    df = spark.createDataFrame(places, "id long, lat double, lon double")
    for most in (300.0, 1500.0, 9000.0):
        got = [(r.src, r.dst) for r in graph.near(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in places for b in places if a[0] != b[0] and km(a, b) <= most}
    want = min(km(a, b) for a in places for b in places if km(a, b) > 0)
    assert abs(graph.closest_km(df, 1.0).first().dist_km - want) < 1e-6
    assert graph.closest_km(df.limit(1)).first().dist_km is None


def test_saved_graph_and_scaler(spark, tmp_path):
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 50.0, 50.0)], "id long, lat double, lon double")
    c = spark.createDataFrame([(1, 3, -0.9, 5), (2, 3, 0.1, 5)], "src long, dst long, corr double, n long")
    edges = graph.linked(s, 500.0, c, 0.7)
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 2), (2, 1), (1, 3), (3, 1)}
    graph.save(edges, s, f"file://{tmp_path}/g", 500.0, 0.7)
    back, nodes, meta = graph.load(spark, f"file://{tmp_path}/g")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges.collect())) and nodes.count() == 3
    assert tuple(meta.select("most_km", "least_corr", "n_nodes", "n_edges").first()) == (500.0, 0.7, 3, 4)
    params = clean.fit_scaler(frame(spark, [1.0, 5.0]), ["v"])
    clean.save_scaler(params, f"file://{tmp_path}/s")
    assert clean.load_scaler(spark, f"file://{tmp_path}/s").collect() == params.collect()


def test_sinks(spark, tmp_path):
    from chronolith.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    sinks.write_layer(df, f"file://{tmp_path}/layer", "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"file://{tmp_path}/layer").collect()) == [(1, "a"), (2, "b"), (2, "c")]
    assert tables.read_or_empty(spark, f"file://{tmp_path}/layer/k=2", "v string").count() == 2 and tables.read_or_empty(spark, f"file://{tmp_path}/none", "v string").count() == 0
    for _ in range(2):
        sinks.append_csv(df, f"file://{tmp_path}/history")
        sinks.write_json(df, f"file://{tmp_path}/latest")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/history").count() == 6 and spark.read.json(f"file://{tmp_path}/latest").count() == 3


def test_stations_from_paths_and_settings(spark, tmp_path):
    for station in ("LAG1", "NKLG"):
        spark.createDataFrame([(station.lower(), 1.0)], "v string, s4 double").coalesce(1).write.parquet(f"file://{tmp_path}/layer/{station}.parquet")
    assert sorted((r.station_id, r.v) for r in tables.station_layer(spark, f"file://{tmp_path}/layer").collect()) == [("LAG1", "lag1"), ("NKLG", "nklg")]
    (tmp_path / "c.json").write_text('{"events": {\n "thresholds": {"watch": 0.2}}}')
    assert tables.thresholds(spark, f"file://{tmp_path}/c.json", {"watch": 0.3, "severe": 0.7}) == {"watch": 0.2, "severe": 0.7}
    (tmp_path / "d.json").write_text("{}")
    assert tables.thresholds(spark, f"file://{tmp_path}/d.json", {"watch": 0.3}) == {"watch": 0.3}


def test_fitted_scorer(spark):
    rows = [([float(i % 7), float(i % 5)], 0.5 * (i % 7) - 0.25 * (i % 5) + 1, True) for i in range(60)] + [([100.0, 3.0], 0.0, False)]
    coefficients, intercept = forecast.fit_linear(spark.createDataFrame(rows, "x array<double>, y double, mask boolean"), "x", "y", "mask")
    assert [round(c, 6) for c in [*coefficients, intercept]] == [0.5, -0.25, 1]


def _stream(spark, tmp_path, rows):
    spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), v) for k, m, v in rows], "k long, t timestamp, v double").write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema("k long, t timestamp, v double").parquet(f"{tmp_path}/in")


def test_dedupe_stream_in_batches(spark, tmp_path):
    source = _stream(spark, tmp_path, [(1, 0, 1.0), (1, 0, 1.0), (2, 5, 2.0), (1, 0, 3.0)])
    for _ in range(2):  # started again, it finds nothing new
        series.write_batches(series.dedupe_stream(source, "t", ["k", "t"]), f"{tmp_path}/out", f"{tmp_path}/cp", "k").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_sessions_stream(spark, tmp_path):
    source = _stream(spark, tmp_path, [(1, m, v) for m, v in ((0, 0.5), (10, 0.9), (20, 0.1), (30, 0.6), (70, 0.4), (100, 0.1), (3000, 0.5))])
    series.sessions_stream(source, "t", "k", "v", 0.4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.peak, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0.4, 1), (0.9, 3)]
