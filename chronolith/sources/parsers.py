"""Text and JSON feeds as tables. Input: a table with a string column; rows that can't be read are left out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _number(c: Column, sentinel: str | None = None) -> Column:
    value = c.try_cast("double")
    return F.when(c != sentinel, value) if sentinel else value


def _array_rows(df: DataFrame, text: str, columns: dict[str, tuple[int, str | None]]) -> DataFrame:
    rows = df.select(F.posexplode(F.from_json(text, "array<array<string>>")).alias("i", "r")).where("i > 0")
    return rows.select(F.get("r", F.lit(0)).try_cast("timestamp_ntz").alias("timestamp"), *[_number(F.get("r", F.lit(i)), s).alias(c) for c, (i, s) in columns.items()]).where("timestamp is not null")


def array_mag(df: DataFrame, text: str) -> DataFrame:
    """timestamp, bz, bt of an array of arrays with a header."""
    return _array_rows(df, text, {"bz": (3, "-999.9"), "bt": (6, "-999.9")})


def array_plasma(df: DataFrame, text: str) -> DataFrame:
    return _array_rows(df, text, {"n_p": (1, "-9999.9"), "v_sw": (2, "-9999.9"), "t_p": (3, "-1.00e+05")})


def object_rows(df: DataFrame, text: str, columns: dict[str, str]) -> DataFrame:
    """timestamp and columns (name -> key) of an array of objects; a missing key is null."""
    rows = df.select(F.explode(F.from_json(text, "array<map<string,string>>")).alias("r"))
    return rows.select(F.try_element_at("r", F.lit("time_tag")).try_cast("timestamp_ntz").alias("timestamp"), *[F.try_element_at("r", F.lit(k)).try_cast("double").alias(c) for c, k in columns.items()]).where("timestamp is not null")


def hemispheric_power(df: DataFrame, text: str) -> DataFrame:
    """hp_north: the mean of the third number of the coordinates that have one; hp_south is nine tenths of it."""
    rows = df.select(F.monotonically_increasing_id().alias("_id"), F.from_json(text, "struct<coordinates:array<array<double>>>").alias("j"))
    c = F.filter("j.coordinates", lambda x: F.size(x) >= 3)
    mean = F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.get(x, F.lit(2))), F.size(c))
    return rows.select(mean.alias("hp_north"), (0.9 * mean).alias("hp_south"))


def kp_lines(df: DataFrame, line: str, first: str, last: str) -> DataFrame:
    """timestamp, kp: eight values of tenths a day, of days between first and last; comments and lines of under 11 fields are none."""
    f = df.select(F.split(F.trim(line), r"\s+").alias("f")).where(~F.get("f", F.lit(0)).startswith("#") & (F.size("f") >= 11))
    day = F.concat_ws("-", F.get("f", F.lit(0)), F.get("f", F.lit(1)), F.get("f", F.lit(2))).try_cast("date")
    # The values before a bad one stay, as a line is read from left to right.
    values = F.transform(F.slice("f", 4, 8), lambda x: x.try_cast("int"))
    bad = F.array_position(F.transform(values, lambda x: x.isNull()), F.lit(True))  # 0: none
    good = F.when(bad == 0, values).otherwise(F.slice(values, F.lit(1), F.greatest(bad - 1, F.lit(0)).cast("int")))
    rows = f.select(day.alias("d"), F.posexplode(good).alias("i", "v")).where(F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.select((F.col("d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("i") * 3)).alias("timestamp"), (F.col("v") / 10).alias("kp"))


def dst_block(df: DataFrame, html: str) -> DataFrame:
    """timestamp, dst: lines `Dst Mon D YYYY` and 24 hourly values within <pre>, of which a page may have several; 9999 is missing, and a line with anything but whole numbers is none."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<pre[^>]*>(.*?)</pre>"), F.lit(1))
    lines = df.select(F.explode(blocks).alias("block")).select(F.explode(F.split("block", "\n")).alias("line"))
    f = lines.select(F.split(F.trim("line"), r"\s+").alias("f")).where((F.get("f", F.lit(0)) == "Dst") & (F.size("f") >= 28))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get("f", F.lit(1)))
    day = F.try_make_timestamp_ntz(F.get("f", F.lit(3)).try_cast("int"), month.cast("int"), F.get("f", F.lit(2)).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)) if hasattr(F, "try_make_timestamp_ntz") else F.concat_ws("-", F.get("f", F.lit(3)), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.get("f", F.lit(2)), 2, "0")).try_cast("timestamp_ntz")
    values = F.transform(F.slice("f", 5, 24), lambda x: x.try_cast("int"))
    rows = f.select(day.alias("d"), values.alias("values")).where(F.col("d").isNotNull() & ~F.exists("values", lambda x: x.isNull())).select("d", F.posexplode("values").alias("i", "v"))
    return rows.select((F.col("d") + F.make_dt_interval(F.lit(0), F.col("i"))).alias("timestamp"), F.nullif(F.col("v").cast("double"), F.lit(9999.0)).alias("dst"))


def _map_values(lines: list[str], n: int) -> list[int]:
    """The numbers of a latitude's lines between blanks; where these aren't n numbers, of columns of five, in which numbers may touch."""
    try:
        apart, why = [int(x) for line in lines for x in line.split()], None
    except ValueError as e:
        apart, why = [], e
    if len(apart) != n:
        try:
            columns = [int(line[i : i + 5]) for line in map(str.rstrip, lines) for i in range(0, len(line), 5)]
        except ValueError:
            columns = []
        if len(columns) == n:
            return columns
    if why:
        raise why
    return apart


def _map_rows(text: str) -> list[tuple]:
    """(epoch, lat, lon, tec) of a map file; ValueError at a number that is none."""
    out: list[tuple] = []
    scale, inside, epoch, lat, axis, lines = -1, False, None, None, [], []

    def close():
        if lat is None:
            return
        values = _map_values(lines, len(axis))
        if axis and len(values) == len(axis):
            out.extend((epoch, lat, lon, None if v == 9999 else v * 10.0**scale) for lon, v in zip(axis, values))

    for line in text.split("\n"):
        tag = line[60:].strip()
        if tag == "EXPONENT":
            scale = int(line[:6])
        elif tag == "START OF TEC MAP":
            inside, lat, lines = True, None, []
        elif tag == "END OF TEC MAP":
            close()
            inside, lat = False, None
        elif tag == "EPOCH OF CURRENT MAP" and inside:
            y, mo, d, h, mi, s = (int(x) for x in line[:60].split()[:6])
            epoch = f"{y:04}-{mo:02}-{d:02} {h:02}:{mi:02}:{s:02}"
        elif tag.startswith("LAT/LON1/LON2/DLON/H") and inside:
            close()
            # Fixed columns: numbers may touch.
            lat, lo, hi, step = (float(line[i : i + 6]) for i in (2, 8, 14, 20))
            axis, lines = [lo + step * i for i in range(int(round((hi - lo) / step)) + 1)], []
        elif inside and lat is not None:
            lines.append(line)
    return out


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for text in b.column(0).to_pylist():
            try:
                out += _map_rows(text or "")
            except ValueError:
                pass  # unreadable: no rows, as said below
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.float64()))], ["epoch", "lat", "lon", "tec"])


def ionosphere_maps(df: DataFrame, text: str, lat: tuple[float, float] = (-20.0, 20.0), lon: tuple[float, float] = (-30.0, 60.0)) -> DataFrame:
    """epoch, lat, lon, tec of map files, a row a file (spark.read.text(..., wholetext=True)); rows of a latitude with another number of values than the axis has are left out, 9999 is missing. A file with a number that can't be read has no rows, and unreadable_maps() names it."""
    rows = df.select(text).mapInArrow(_maps, "epoch string, lat double, lon double, tec double")
    return rows.withColumn("epoch", F.col("epoch").cast("timestamp_ntz")).where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def _unreadable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                _map_rows(text or "")
            except ValueError as e:
                out.append((path, str(e)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["path", "problem"])


def unreadable_maps(df: DataFrame, path: str, text: str) -> DataFrame:
    """path and problem of the map files that ionosphere_maps() gives no rows of because a number can't be read."""
    return df.select(F.col(path).cast("string").alias("path"), text).mapInArrow(_unreadable, "path string, problem string")


def in_region(df: DataFrame, lat: tuple[float, float] = (-20.0, 20.0), lon: tuple[float, float] = (-30.0, 60.0)) -> DataFrame:
    return df.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))
