"""Threshold events as gaps and islands in buckets of time, alerts and map rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.expressions import LEVELS, SECTOR_IMPACTS, level_of
from chronolith.operators.ordered import position, quantiles
from chronolith.operators.segments import scan


def level_table(thresholds: dict[str, float] | None = None) -> Column:
    """Array of (level, threshold); an unknown level has no rank."""
    at = thresholds or {name: least for name, least, *_ in LEVELS}
    return F.array(*[F.struct(F.lit(n).alias("level"), F.lit(v).alias("threshold")) for n, v in at.items()])


def rank_of(level: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, _, rank, *_ in LEVELS:
        out = out.when(level == name, rank)
    return out.otherwise(0)


def colour_of(level: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, _, _, colour, _ in LEVELS:
        out = out.when(level == name, colour)
    return out.otherwise("green")


def detect(df: DataFrame, value: str, time: str, key: str, minutes: int = 30, least_minutes: int = 30, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Runs of rows at or above a level's threshold, by key and level: event_id, key, level, onset, end, peak_s4, mean_s4, duration_min, colour.

    A null ends a run, a missing time step doesn't; a run has at least max(1, least_minutes // minutes) rows. Events are
    numbered by key, then the higher threshold, then onset. Without events the table is empty, with the same columns.
    """
    at = thresholds or {name: least for name, least, *_ in LEVELS}
    on = lambda least: F.coalesce(F.col(value) >= least, F.lit(False))
    # One scan numbers the islands of all levels; rows are only then stacked by level.
    rows = scan(df.select(key, time, value), [key], [time], sums={f"_{i}": F.when(on(least), 0).otherwise(1) for i, least in enumerate(at.values())})
    levels = [F.struct(F.lit(n).alias("level"), F.lit(least).alias("threshold"), F.when(on(least), F.col(f"_{i}")).alias("_island")) for i, (n, least) in enumerate(at.items())]
    runs = rows.select(key, time, value, F.inline(F.array(*levels))).where("_island is not null").groupBy(key, "level", "threshold", "_island").agg(F.min(time).alias("onset"), F.max(time).alias("end"), F.max(value).alias("peak_s4"), F.avg(value).alias("mean_s4"), F.count("*").alias("n"))
    runs = runs.where(F.col("n") >= max(1, least_minutes // minutes))
    numbered = position(runs, F.col(key), [F.desc("threshold"), F.col("onset")], "event_id")
    return numbered.select("event_id", key, "level", "onset", "end", "peak_s4", "mean_s4", (F.col("n") * minutes).alias("duration_min"), colour_of(F.col("level")).alias("colour"))


def calibrate(df: DataFrame, value: str, least_rows: int = 100) -> DataFrame:
    """One row: watch, warning, severe from the 75th, 90th and 99th percentile, held in their ranges and apart; below least_rows rows .3, .4, .7."""
    n = df.agg(F.count("*").alias("n"))  # one row
    q = n.join(F.broadcast(quantiles(df, value, [], [0.75, 0.9, 0.99]).select("q")), how="left")
    held = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    q = q.withColumn("watch", held(F.col("q")[0], 0.15, 0.40)).withColumn("warning", F.greatest(held(F.col("q")[1], 0.30, 0.60), F.col("watch") + 0.05)).withColumn("severe", F.greatest(held(F.col("q")[2], 0.60, 0.95), F.col("warning") + 0.10))
    few = (F.col("n") < least_rows) | F.col("q").isNull()
    return q.select(*[F.when(few, d).otherwise(F.col(c)).alias(c) for c, d in (("watch", 0.3), ("warning", 0.4), ("severe", 0.7))])


def alerts(events: DataFrame, now: Column, key: str) -> DataFrame:
    """Active events (end at or after now) as alert rows: code, key, level, colour, action, peak_s4, n_active, worst."""
    active = events.where(F.col("end") >= now)
    total = active.agg(F.count("*").alias("n_active"), F.max_by("level", rank_of(F.col("level"))).alias("worst"))  # one row
    action = F.when(F.lit(False), "")
    for name, *_, advice in LEVELS:
        action = action.when(F.col("level") == name, advice)
    rows = active.select(F.format_string("EVT-%05d", "event_id").alias("code"), key, F.upper("level").alias("level"), "colour", action.otherwise("").alias("action"), F.round("peak_s4", 4).alias("peak_s4"))
    return rows.crossJoin(F.broadcast(total))


def map_rows(events: DataFrame, stations: DataFrame, key: str) -> DataFrame:
    """Events with a point feature each, as JSON: unknown stations stand at 0, 0 without a country."""
    s = stations.select(F.col("id").alias(key), "lat", "lon", "country")
    j = events.join(s, key, "left").withColumns({"lat": F.round(F.coalesce("lat", F.lit(0.0)), 4), "lon": F.round(F.coalesce("lon", F.lit(0.0)), 4), "country": F.coalesce("country", F.lit(""))})
    props = F.struct("event_id", key, "level", "country", F.round("peak_s4", 4).alias("peak_s4"), "duration_min")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), props.alias("properties")))
    return j.select("event_id", key, "level", "lon", "lat", "country", feature.alias("feature"))


def latest(df: DataFrame, time: str, key: str, columns: list[str]) -> DataFrame:
    """Each column's last value in time that isn't null, by key."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns])


def dashboard(stations: DataFrame, forecast: DataFrame, time: str, key: str, value: str) -> DataFrame:
    """Stations with their latest value (else 0), its level, colour and marker radius."""
    last = latest(forecast, time, key, [value]).withColumnRenamed(key, "id")
    s4 = F.coalesce(F.col(value), F.lit(0.0))
    out = stations.join(last, "id", "left").withColumn("s4", s4).withColumn("level", level_of(F.col("s4")))
    return out.select("id", "lat", "lon", "s4", "level", colour_of(F.col("level")).alias("colour"), (12 + 20 * F.col("s4")).alias("radius"))


def feature_collections(rows: DataFrame, by: list[str]) -> DataFrame:
    """map_rows as one FeatureCollection (JSON) for each value of `by`, such as a station or a day: by, n_features, collection. `by` is to bound what one collection holds."""
    features = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "feature"))), lambda x: x["feature"])
    return rows.groupBy(*by).agg(F.count("*").alias("n_features"), F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}")).alias("collection"))


def impacts(alerts: DataFrame) -> DataFrame:
    """Alerts with a row for each sector: sector and what the level means there."""
    table = F.array(*[F.struct(F.lit(s).alias("sector"), F.lit(n).alias("_level"), F.lit(text).alias("impact")) for s, own in SECTOR_IMPACTS.items() for n, text in own.items()])
    return alerts.select("*", F.inline(table)).where(F.col("_level") == F.lower("level")).drop("_level")


def first_alerts(alerts: DataFrame, n: int) -> DataFrame:
    """The n highest alerts, by level, then peak, then code: what a short message has room for."""
    return alerts.orderBy(rank_of(F.lower("level")).desc(), F.desc("peak_s4"), "code").limit(n)
