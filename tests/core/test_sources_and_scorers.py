"""What round three added: packed files, listings, merges, catalogues, stream events, scorers, closest pairs, correlations."""

import json
import math
import os
import random
import shutil
import subprocess
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import expressions as X
from chronolith.operators import events, graph, regress
from chronolith.sources import packed, parsers, sinks, tables
from chronolith.streaming import events as stream_events


def pack(data: bytes, widest: int = 16, clear_at: int | None = None) -> bytes:
    """A .Z file, by the format's rules."""
    groups, codes, width, table = [], [], 9, {bytes([i]): i for i in range(256)}
    free, before = 257, b""

    def flush(whole: bool):
        bits = sum(c << (width * i) for i, c in enumerate(codes))
        size = width if whole else -(-len(codes) * width // 8)
        groups.append(bits.to_bytes(size, "little"))
        codes.clear()

    def put(code, clear=False):
        nonlocal width
        codes.append(code)
        if len(codes) == 8:
            flush(True)
        if clear or (free > (1 << width) - 1 and width < widest):
            if codes:
                flush(True)
            width = 9 if clear else width + 1

    for i in range(len(data)):
        one = data[i : i + 1]
        if before + one in table:
            before += one
            continue
        put(table[before])
        if free < 1 << widest:
            table[before + one] = free
            free += 1
        elif clear_at:
            put(256, clear=True)
            table, free = {bytes([i]): i for i in range(256)}, 257
        before = one
    if before:
        put(table[before])
    if codes:
        flush(False)
    return b"\x1f\x9d" + bytes([widest | 0x80]) + b"".join(groups)


TEXTS = [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"the cat sat on the mat " * 900, bytes(random.Random(1).randrange(256) for _ in range(6000)), " ".join(str(i * i) for i in range(9000)).encode()]


@pytest.mark.parametrize("widest,clear", [(10, 1), (12, 1), (12, None), (16, None)])
def test_unpack(widest, clear):
    for data in TEXTS:
        z = pack(data, widest, clear)
        assert packed.unpack(z) == data
        if shutil.which("gzip"):
            assert subprocess.run(["gzip", "-dc"], input=z, capture_output=True).stdout == data
    for bad in (b"", b"\x1f\x8b\x08", b"\x1f\x9d\x07", b"\x1f\x9d\x90" + b"\xff" * 40):
        with pytest.raises(ValueError):
            packed.unpack(bad)


def test_packed_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.Z").write_bytes(pack("wörter\n".encode() * 50))
    (tmp_path / "y.Z").write_bytes(b"nothing of the kind")
    got = {r.path.rsplit("/", 1)[1]: r for r in packed.read_packed(spark, str(tmp_path)).collect()}
    assert got["x.Z"].text == "wörter\n" * 50 and got["x.Z"].problem is None and got["y.Z"].text is None and "not a .Z" in got["y.Z"].problem


def test_a_bad_map_file_stops_nothing(spark):
    line = lambda text, tag: f"{text:<60}{tag}"
    good = "\n".join([line("    -1", "EXPONENT"), line("", "START OF TEC MAP"), line("  2024     1     2     0     0     0", "EPOCH OF CURRENT MAP"), line(f"  {0.0:6.1f}{0.0:6.1f}{10.0:6.1f}{10.0:6.1f}{450.0:6.1f}", "LAT/LON1/LON2/DLON/H"), "   12 9999", line("", "END OF TEC MAP")])
    df = spark.createDataFrame([("good", good), ("bad", good.replace("   12", "  1x2")), ("none", None)], "path string, text string")
    assert sorted(r.tec if r.tec else -1 for r in parsers.ionosphere_maps(df, "text").collect()) == [-1, 1.2000000000000002]
    assert [r.path for r in parsers.unreadable_maps(df, "path", "text").collect()] == ["bad"]


def test_listing_and_latest(spark, tmp_path):
    assert tables.listing(spark, f"{tmp_path}/none").count() == 0 and tables.latest_file(spark, f"{tmp_path}/none") is None
    for name, body in (("b_2.csv", "x\n2\n"), ("b_1.csv", "x\n1\n"), ("z.txt", "x\n")):
        (tmp_path / name).write_text(body)
        time.sleep(0.02)
    assert {r.name: r.length for r in tables.listing(spark, str(tmp_path), "*.csv").collect()} == {"b_1.csv": 4, "b_2.csv": 4}
    assert [r.x for r in tables.latest_csv(spark, str(tmp_path), "x int").collect()] == [2]
    assert tables.latest_file(spark, str(tmp_path), "*.csv", by="modified").endswith("b_1.csv")
    plan = tables.listing(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    (tmp_path / "empty").mkdir()
    assert tables.latest_csv(spark, f"{tmp_path}/empty", "x int").count() == 0


def test_merge_touches_only_its_partitions(spark, tmp_path):
    path, schema = str(tmp_path / "layer"), "k long, d string, v long"
    make = lambda rows: spark.createDataFrame(rows, schema)
    tables.merge_into(make([(1, "a", 1), (1, "a", 0), (2, "b", 5), (9, None, 3)]), path, ["k", "d"], ["v"], "d")
    read = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(path).select("k", "d", "v").collect()), key=str)
    assert read() == [(1, "a", 0), (2, "b", 5), (9, None, 3)]  # the first flush is deduplicated as well
    files = lambda p: {f.name for f in (tmp_path / "layer").glob(f"d={p}/*.parquet")}
    b, a = files("b"), files("a")
    tables.merge_into(make([(1, "a", 7), (3, "a", 8), (3, "a", 9), (4, "c", 1), (9, None, 4)]), path, ["k", "d"], ["v"], "d")
    assert read() == [(1, "a", 0), (2, "b", 5), (3, "a", 8), (4, "c", 1), (9, None, 3)]
    assert files("b") == b and files("a") != a
    tables.merge_into(make([]), path, ["k", "d"], ["v"], "d")
    assert len(read()) == 5


def test_lookup_overrides_and_names(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "id int, name string")
    assert [tuple(r) for r in tables.lookup(df, dim, "k", "id", ["name"], "found").orderBy("k").collect()] == [(None, None, False), (1, "a", True), (2, None, False)]
    own = spark.createDataFrame([(("x", 2), None)], "alerts struct<to: string, n: int>, sources struct<user: string>")
    got = tables.overridden(own, {"alerts.to": "A", "sources.user": "B", "other.field": "C", "plain": "D", "alerts.n": "E"}, {"A": "y", "B": "me", "C": "new", "D": "1", "E": ""}).first()
    assert got.alerts.to == "y" and got.alerts.n == 2 and got.sources.user == "me" and got.other.field == "new" and got.plain == "1"
    names = ["/a/b/abcd0000_20240600000_01D_30S_MO.crx.gz", "abcd0000_20233660000_01D_30S_MO.crx", "readme.txt", None]
    made = X.file_tokens(F.col("n"))
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(*[c.alias(k) for k, c in made.items()]).collect()
    assert (rows[0].station, str(rows[0].day), rows[0].format, rows[0].packed) == ("ABCD", "2024-02-29", "crx", "gz")
    assert rows[1].day is None and rows[1].station == "ABCD" and rows[2].station is None and rows[3].station is None


def test_alerts_and_catalogue(spark, tmp_path):
    rows = spark.createDataFrame([("EVT-1", 0.5)], "code string, peak double")
    sinks.dispatch(rows, str(tmp_path))
    sinks.dispatch(rows.limit(0), str(tmp_path))
    sinks.dispatch(rows, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/alert_history").count() == 2 and spark.read.json(f"{tmp_path}/alert_latest").count() == 1
    (tmp_path / "out").mkdir()
    (tmp_path / "out/forecast.csv").write_text("x")
    (tmp_path / "out/map.v2.geojson").write_text("{}")
    items = sinks.stac_items(tables.listing(spark, f"{tmp_path}/out"), (-30, -20, 60, 20))
    made = {(i := json.loads(r.item))["id"]: i for r in items.collect()}
    assert set(made) == {"forecast", "map.v2"} and made["forecast"]["assets"]["data"]["type"] == "text/csv" and made["map.v2"]["assets"]["data"]["type"] == "application/geo+json"
    ring = made["forecast"]["geometry"]["coordinates"][0]
    assert len(ring) == 5 and ring[0] == ring[4] == [-30.0, -20.0] and ring[2] == [60.0, 20.0] and made["forecast"]["properties"]["datetime"].endswith("Z")
    layer = spark.createDataFrame([(1.0, 2.0), (-3.0, 9.0)], "lat double, lon double").withColumn("t", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    sinks.write_catalogue(items, sinks.extent(layer, "t"), f"{tmp_path}/stac", "own", "What there is")
    head = json.loads(spark.read.text(f"{tmp_path}/stac/catalog").first()[0])
    assert head["extent"]["spatial"]["bbox"] == [[2.0, -3.0, 9.0, 1.0]] and head["extent"]["temporal"]["interval"][0][0] == "2024-01-02T03:04:05Z" and spark.read.text(f"{tmp_path}/stac/items").count() == 2


def test_least_squares_like_numpy(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in (1, 2):
        x = rng.normal(5, 2, (300, 12))
        y = x @ rng.normal(0, 1, 12) + g + rng.normal(0, 0.1, 300)
        w = rng.integers(0, 4, 300)
        rows += [(g, a.tolist(), float(b), int(c)) for a, b, c in zip(x, y, w)]
        s = np.sqrt(w)[:, None]
        want[g] = np.linalg.lstsq(np.hstack([x, np.ones((300, 1))]) * s, y * s[:, 0], rcond=None)[0]
    rows += [(1, None, 1.0, 1), (1, [1.0] * 11 + [None], 1.0, 1), (2, [1.0] * 12, None, 1), (3, [2.0] * 12, 6.0, 1), (3, [2.0] * 12, 8.0, 1)]
    df = spark.createDataFrame(rows, "g int, x array<double>, y double, w int").repartition(5)
    got = {r.g: r for r in regress.fit(df, ["g"], "x", 12, "y", F.col("w")).collect()}
    for g in (1, 2):
        assert np.allclose([*got[g].coefficients, got[g].intercept], want[g], atol=1e-6)
    assert abs(sum(c * 2 for c in got[3].coefficients) + got[3].intercept - 7) < 1e-6  # what can't be told apart still gives the mean
    ridge = regress.fit(df.where("g = 1"), ["g"], "x", 12, "y", ridge=1e9).first()
    assert max(map(abs, ridge.coefficients)) < 0.01


def test_cross_validation_with_twelve_lags(spark):
    rng = np.random.default_rng(9)
    x = rng.random((600, 12))
    y = x @ np.linspace(0, 1, 12) + rng.normal(0, 0.05, 600)
    df = spark.createDataFrame([(i % 3, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, x array<double>, y double")
    folds = df.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("held", F.col("k") == F.col("fold"))
    for r in regress.cross_validate(folds, "x", 12, "y", "fold", "held").collect():
        held = np.arange(600) % 3 == r.fold
        full = np.hstack([x, np.ones((600, 1))])
        e = full[held] @ np.linalg.lstsq(full[~held], y[~held], rcond=None)[0] - y[held]
        assert r.n == 200 and math.isclose(r.rmse, math.sqrt((e * e).mean()), rel_tol=1e-6) and math.isclose(r.r2, 1 - (e * e).mean() / y[held].var(), rel_tol=1e-6)


def test_bootstrap_draws(spark):
    drawn = regress.bootstrap(spark.range(4000), [F.col("id")], 3, seed=1)
    assert drawn.exceptAll(regress.bootstrap(spark.range(4000).repartition(7), [F.col("id")], 3, seed=1)).count() == 0
    for r in drawn.groupBy("member").agg(F.sum("draws").alias("n"), F.count("*").alias("rows"), F.max("draws").alias("most")).collect():
        assert abs(r.n - 4000) < 300 and abs(r.rows - 4000 * (1 - math.exp(-1))) < 150 and r.most >= 4


def test_closest_pair(spark):
    rng = random.Random(3)
    far = [(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(300)]
    heap = [(1000 + i, 10 + rng.random() * 1e-3, 20 + rng.random() * 1e-3) for i in range(300)]  # a third of a city block
    same = [(2000 + i, -5.0, 7.0) for i in range(300)]
    for rows in (far, heap + far, same, same + far[:2], far[:1], [(1, 0.0, 179.9999), (2, 0.0, -179.9999)]):
        df = spark.createDataFrame(rows, "id long, lat double, lon double")
        places = {r[1:] for r in rows}
        rad = np.radians(np.array(sorted(places)))
        d = np.inf
        for i in range(len(rad) - 1):
            a = np.sin((rad[i + 1 :, 0] - rad[i, 0]) / 2) ** 2 + np.cos(rad[i, 0]) * np.cos(rad[i + 1 :, 0]) * np.sin((rad[i + 1 :, 1] - rad[i, 1]) / 2) ** 2
            d = min(d, (2 * X.EARTH_KM * np.arcsin(np.sqrt(np.minimum(a, 1)))).min())
        got = graph.closest_km(df).first().dist_km
        assert got is None if d == np.inf else math.isclose(got, d, rel_tol=1e-6)


@pytest.mark.parametrize("blocks", [1, 3])
def test_correlations_pair_by_pair(spark, blocks):
    rng = np.random.default_rng(6)
    names, v = [f"s{i}" for i in range(7)], rng.normal(1e6, 1, (500, 7))
    v[:, 3] = 0.1
    v[:, 4] = v[:, 2] * -2
    there = rng.random((500, 7)) < 0.7
    rows = [(names[j], i * 3600, float(v[i, j]) if there[i, j] else None) for i in range(500) for j in range(7)] + [("s0", 0, float(v[0, 0])) for _ in range(2) if there[0, 0]]
    df = spark.createDataFrame(rows, "k string, s long, v double").withColumn("t", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {(r.src, r.dst): r for r in graph.correlations(df, "v", "t", "k", blocks=blocks).collect()}
    assert len(got) == 21
    for i in range(7):
        for j in range(i + 1, 7):
            on = there[:, i] & there[:, j]
            r = got[names[i], names[j]]
            want = 0.0 if 3 in (i, j) else np.corrcoef(v[on, i], v[on, j])[0, 1]
            assert r.n == on.sum() and math.isclose(r.corr, want, abs_tol=1e-6)


def test_stream_events_are_the_batch_events(spark, tmp_path):
    """A file stream in several batches, stopped and taken up again on the way, finds what detect() finds."""
    rng = random.Random(12)
    base, rows = 1_700_000_000 // 3600 * 3600, []
    for k in range(4):
        t = base
        for _ in range(120):
            t += rng.choice([1800, 1800, 1800, 5400])
            rows.append((k, t, rng.choice([None, 0.1, 0.35, 0.45, 0.8, 0.8])))
    schema = "k long, s long, v double"
    batch = spark.createDataFrame(rows, schema).withColumn("t", F.timestamp_seconds("s"))
    want = sorted(tuple(r) for r in events.detect(batch.withColumn("t", F.col("t").cast("timestamp_ntz")), "v", "t", "k", 30, 60).select("k", "level", F.unix_seconds(F.col("onset").cast("timestamp")), F.unix_seconds(F.col("end").cast("timestamp")), F.round("peak_s4", 9), F.round("mean_s4", 9), "duration_min").collect())
    source = tmp_path / "in"
    source.mkdir()
    rows.sort(key=lambda r: r[1])
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for p in parts:
        rng.shuffle(p)
    parts.append([(99, base + 400 * 86_400, 0.0)])
    parts.append([(99, base + 401 * 86_400, 0.0)])
    spark.conf.set(*stream_events.PROVIDER)
    try:
        def run():
            df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)).withColumn("t", F.timestamp_seconds("s"))
            out = stream_events.detect_stream(df, "v", "t", "k", 30, 60, late="2 hours", close_hours=48)
            q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            q.awaitTermination(170)
            assert q.exception() is None

        for i, p in enumerate(parts):
            (source / f"{i:02}.json").write_text("".join(json.dumps({"k": k, "s": s} | ({} if v is None else {"v": v})) + "\n" for k, s, v in p))
            os.utime(source / f"{i:02}.json", (base + i, base + i))  # files are taken in this order
            if i in (2, len(parts) - 1):
                run()
        got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "level", F.unix_seconds("onset"), F.unix_seconds("end"), F.round("peak_s4", 9), F.round("mean_s4", 9), "duration_min").collect())
        assert len(want) > 40 and got == want
    finally:
        spark.conf.unset(stream_events.PROVIDER[0])
