"""Where results go: layers of Parquet by key, a CSV history that grows, JSON lines, alerts, a catalogue of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_layer(df: DataFrame, path: str, by: str, files: int = 1) -> None:
    """A folder for each value of `by` with about `files` files, so that a reader of one key reads its folder alone. A layer is replaced as a whole."""
    df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.mode("overwrite").partitionBy(by).parquet(path)


def append_csv(df: DataFrame, path: str, at: str = "generated_utc") -> None:
    """Rows added to a CSV history, with the time of writing."""
    df.withColumn(at, F.current_timestamp()).write.mode("append").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """The latest rows as JSON lines, in place of those before."""
    df.write.mode("overwrite").json(path)


def dispatch(alerts: DataFrame, folder: str) -> None:
    """Alerts to both of their places below the folder: alert_latest as JSON lines, in place of the last ones, and alert_history as CSV, added to. Without alerts the latest are none, and the history stays as it is."""
    write_json(alerts, f"{folder}/alert_latest")
    append_csv(alerts, f"{folder}/alert_history")


#: The media type by ending.
MEDIA = {"csv": "text/csv"}
OTHER_MEDIA = "application/geo+json"


def stac_items(files: DataFrame, bbox: tuple[float, float, float, float], product: str = "s4_forecast", title: str = "forecast") -> DataFrame:
    """(path, item) of a listing (tables.listing()): a STAC 1.0 item as JSON for each file. bbox: west, south, east, north, the region that the files cover.

    The item is named by the file's name without its ending and dated by when the file was written. No file is opened; one
    that isn't there isn't in a listing.
    """
    west, south, east, north = map(float, bbox)
    ring = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))])
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    media = F.lit(OTHER_MEDIA)
    for end, kind in MEDIA.items():
        media = F.when(ending == end, kind).otherwise(media)
    asset = F.struct(F.col("path").alias("href"), media.alias("type"), F.col("name").alias("title"), F.array(F.lit("data")).alias("roles"))
    properties = F.struct(F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.lit(f"{title} {product}").alias("title"), F.lit(product).alias("product_type"))
    item = F.struct(
        F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), F.regexp_replace("name", r"\.[^.]+$", "").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.array(*map(F.lit, (west, south, east, north))).alias("bbox"), properties.alias("properties"), F.array().cast("array<string>").alias("links"), F.struct(asset.alias("data")).alias("assets"),
    )
    return files.select("path", F.to_json(item).alias("item"))


def extent(rows: DataFrame, time: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row: west, south, east, north, first, last of a layer, by one aggregate."""
    return rows.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"), F.min(time).alias("first"), F.max(time).alias("last"))


def write_catalogue(items: DataFrame, covered: DataFrame, folder: str, name: str, description: str) -> None:
    """A STAC 1.0 catalogue below the folder: catalog as one JSON line with the extent (one row of extent()), and items, a line each, so that no number of files has to fit into one document."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    spatial = F.struct(F.array(F.array("west", "south", "east", "north")).alias("bbox"))
    temporal = F.struct(F.array(F.array(stamp("first"), stamp("last"))).alias("interval"))
    links = F.array(F.struct(F.lit("items").alias("rel"), F.lit("./items").alias("href")))
    head = covered.select(F.to_json(F.struct(F.lit("Catalog").alias("type"), F.lit(name).alias("id"), F.lit("1.0.0").alias("stac_version"), F.lit(description).alias("description"), F.struct(spatial.alias("spatial"), temporal.alias("temporal")).alias("extent"), links.alias("links"))).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{folder}/catalog")
    items.select(F.col("item").alias("value")).write.mode("overwrite").text(f"{folder}/items")
