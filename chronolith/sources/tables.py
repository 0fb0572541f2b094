"""Layers of Parquet: guarded reads, merges that keep the first row of a key, and what is still to be taken in."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The Parquet table at path with this schema, or an empty one if nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def station_layer(spark: SparkSession, folder: str, name: str = "station_id") -> DataFrame:
    """All `<station>.parquet` files or folders below the folder, with the station from the path."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.withColumn(name, F.regexp_extract("_metadata.file_path", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1))


def settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: the JSON settings at path, as `schema` has them; what is missing there is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def thresholds(spark: SparkSession, path: str, default: dict[str, float]) -> dict[str, float]:
    """events.thresholds of the settings (a number a level), or the default of a level that has none."""
    row = settings(spark, path, "events struct<thresholds: map<string, double>>").first()
    own = (row["events"]["thresholds"] if row and row["events"] else None) or {}
    return {level: own.get(level) if own.get(level) is not None else least for level, least in default.items()}


def overridden(settings: DataFrame, names: Mapping[str, str], environment: Mapping[str, str] | None = None) -> DataFrame:
    """settings with what the environment says: names has an environment variable for each field, such as "alerts.email_to"; an unset or empty one changes nothing. Fields of structs are set inside them, others become columns."""
    environment = os.environ if environment is None else environment
    for field, variable in names.items():
        value = environment.get(variable)
        if value:
            top, _, inner = field.partition(".")
            is_struct = top in settings.columns and isinstance(settings.schema[top].dataType, StructType)
            if inner and not is_struct:
                settings = settings.withColumn(top, F.struct(F.lit(value).alias(inner)))
            elif inner:
                # A struct that is null in the settings is made, its other fields null.
                settings = settings.withColumn(top, F.coalesce(F.col(top), F.from_json(F.lit("{}"), settings.schema[top].dataType)).withField(inner, F.lit(value)))
            else:
                settings = settings.withColumn(top, F.lit(value))
    return settings


LISTING = "path string, name string, modified timestamp, length long"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, modified and length of the files below the folder whose names match the pattern. No file is opened. Nothing there: an empty table."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")


def latest_file(spark: SparkSession, folder: str, pattern: str = "*", by: str = "name") -> str | None:
    """The path of the file whose name sorts last, or with by="modified" that was written last (of equally new ones the last name); None if there is none. Runs a job over the listing."""
    return listing(spark, folder, pattern).agg(F.max_by("path", F.struct(*([by] if by == "name" else [by, "name"])))).first()[0]


def latest_csv(spark: SparkSession, folder: str, schema: str, by: str = "name") -> DataFrame:
    """The latest CSV file of the folder; the others aren't read. Without one an empty table."""
    path = latest_file(spark, folder, "*.csv", by)
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).option("header", True).csv(path)


def lookup(df: DataFrame, dimension: DataFrame, on: str, key: str, columns: list[str], found: str | None = None) -> DataFrame:
    """df with columns of the dimension's row whose key is in `on`, null where there is none; found: a boolean that says whether. Of rows that repeat a key the least counts."""
    once = dimension.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*columns)).alias("_row"))
    out = df.join(once, F.col(on) == F.col("_key"), "left").withColumns({c: F.col("_row")[c] for c in columns})
    return (out.withColumn(found, F.col("_key").isNotNull()) if found else out).drop("_key", "_row")


def merge_first(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Both tables with one row a key: that of the existing table, or else the first new one in `order`."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = Window.partitionBy(*keys).orderBy("_new", *order)
    return both.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at", "_new")


def merge_into(new: DataFrame, path: str, keys: list[str], order: list[str], partition: str) -> None:
    """Adds what the layer at path lacks: one row a key, of which rows that are there come first.

    The layer is partitioned by `partition`, a function of the keys, such as the day. Only partitions that have new rows
    are read and written again; the others' files stay. The first flush is deduplicated as well. Nothing new: nothing is
    written. A row whose partition value is null goes to the partition of nulls.
    """
    spark = new.sparkSession
    there = read_or_empty(spark, path, new.schema)
    touched = new.select(partition).distinct().withColumnRenamed(partition, "_touched")
    old = there.join(touched, F.col(partition).eqNullSafe(F.col("_touched")), "left_semi")
    merged = merge_first(old, new, keys, order)
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def pending(wanted: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """What of `wanted` the manifest of finished work lacks."""
    return wanted.join(manifest, keys, "left_anti")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
