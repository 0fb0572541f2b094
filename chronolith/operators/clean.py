"""Resampling, gap filling, outliers and scaling of series by key, in buckets of time (see segments) and aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.expressions import clip, micros
from chronolith.operators.ordered import quantiles
from chronolith.operators.segments import DAY_US, numbered, scan

AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "median": F.median, "count": F.count}


def resample(df: DataFrame, time: str, step: str, how: Mapping[str, str], by: list[str], dense: bool = True) -> DataFrame:
    """Tumbling bins of `step` (a divisor of the day), left-closed and labelled by their starts: by, time, and how's columns.

    how: column -> name in AGGREGATES, or "first" for the first value in time that isn't null. dense: bins without a row
    between a key's first and last are there with nulls.
    """
    agg = lambda c, f: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(time))) if f == "first" else AGGREGATES[f](c)
    bins = df.groupBy(*by, F.window(time, step).alias("_w")).agg(*[agg(c, f).alias(c) for c, f in how.items()]).select(*by, F.col("_w.start").alias(time), *how)
    if not dense:
        return bins
    # A bin gives itself and the empty ones up to the next.
    width = F.expr(f"interval {step}")
    spread = scan(bins, by, [time], leads={"_next": F.col(time)}).withColumn("_at", F.sequence(F.col(time), F.coalesce(F.col("_next") - width, F.col(time)), width))
    rows = spread.select(*by, F.posexplode("_at").alias("_i", "_t"), *how)
    return rows.select(*by, F.col("_t").alias(time), *[F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in how])


def fill_gaps(df: DataFrame, time: str, columns: list[str], by: list[str], limit: int, strict: bool = False, by_time: bool = False) -> DataFrame:
    """Nulls between values are filled on the line between them, those at the ends with the nearest value.

    A null is filled if one of the values beside it is at most `limit` rows away; strict: only if its gap has at most
    `limit` rows and a value on either side. by_time: the line follows the time instead of the row number.
    """
    df = numbered(df, by, [time]).withColumn("_x", micros(time) if by_time else F.col("_row"))
    seen = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_row").alias("r"), F.col("_x").alias("x"))) for c in columns}
    df = scan(df, by, [time, "_row"], lasts={f"_p_{c}": x for c, x in seen.items()}, nexts={f"_n_{c}": x for c, x in seen.items()})
    for c in columns:
        p, n, row = F.col(f"_p_{c}"), F.col(f"_n_{c}"), F.col("_row")
        line = p["v"] + (n["v"] - p["v"]) * F.try_divide(F.col("_x") - p["x"], n["x"] - p["x"])
        if strict:
            fill = F.when(n["r"] - p["r"] - 1 <= limit, line)
        else:
            fill = F.when((row - p["r"] <= limit) | (n["r"] - row <= limit), F.coalesce(line, p["v"], n["v"]))
        df = df.withColumn(c, F.coalesce(c, fill)).drop(f"_p_{c}", f"_n_{c}")
    return df.drop("_row", "_x")


def upsample(df: DataFrame, grid: DataFrame, time: str, column: str, by: list[str], width_us: int = 365 * DAY_US) -> DataFrame:
    """`column` on the times of `grid` (by and time), on the line in time between the values beside; before the first value null, after the last the last. width_us: how much time a task's bucket of a key spans."""
    known = df.where(F.col(column).isNotNull()).select(*by, time, column, F.lit(False).alias("_wanted"))
    both = known.unionByName(grid.select(*by, time, F.lit(None).cast("double").alias(column), F.lit(True).alias("_wanted")))
    # At one time the known value comes before the wanted time on the way up, and is found from it on the way down.
    both = both.withColumn("_rank", F.col("_wanted").cast("int"))
    seen = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), micros(time).alias("x")))
    both = scan(both, by, [time, "_rank"], width_us=width_us, lasts={"_p": seen}, nexts={"_n": seen}).drop("_rank")
    p, n = F.col("_p"), F.col("_n")
    line = F.when(p["x"] == micros(time), p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * F.try_divide(micros(time) - p["x"], n["x"] - p["x"]))
    return both.where("_wanted").withColumn(column, F.coalesce(line, p["v"])).drop("_p", "_n", "_wanted")


def outliers(df: DataFrame, columns: list[str], by: list[str], k: float = 3.0, replace: str = "nan") -> DataFrame:
    """Values beyond k interquartile ranges from the quartiles of their key are nulled, or with replace="clip" set to the bound."""
    for c in columns:
        quartiles = quantiles(df, c, by, [0.25, 0.75]).select(*by, F.col("q").alias(f"_q_{c}"))
        df = df.join(quartiles, by, "left") if by else df.join(F.broadcast(quartiles), how="left")  # without a key, one row
        q = F.col(f"_q_{c}")
        lo, hi = q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])
        df = df.withColumn(c, F.when(F.col(c).between(lo, hi), F.col(c)) if replace == "nan" else F.coalesce(clip(F.col(c), lo, hi), F.col(c)))
    return df.drop(*[f"_q_{c}" for c in columns])


def fit_scaler(df: DataFrame, columns: list[str], bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """(feature, lo, hi): the columns' extremes or their bounds; where both are equal, hi is one more."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    rows = [F.struct(F.lit(c).alias("feature"), *((F.lit(x).cast("double").alias(n)) if x is not None else F.col(f"{n}_{c}").alias(n) for n, x in zip(("lo", "hi"), (bounds or {}).get(c, (None, None))))) for c in columns]
    return ends.select(F.inline(F.array(*rows))).withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))


def scale(df: DataFrame, params: DataFrame, columns: list[str], inverse: bool = False) -> DataFrame:
    """Columns mapped from [lo, hi] to [0, 1] and clipped, or back. params has a row a feature, of which one row is made and broadcast; a column without a feature becomes null."""
    ends = params.agg(*[F.max(F.when(F.col("feature") == c, F.struct("lo", "hi"))).alias(f"_p_{i}") for i, c in enumerate(columns)])  # one row

    def mapped(i: int, c: str) -> Column:
        lo, hi = F.col(f"_p_{i}.lo"), F.col(f"_p_{i}.hi")
        return F.col(c) * (hi - lo) + lo if inverse else clip((F.col(c) - lo) / (hi - lo), 0.0, 1.0)

    return df.crossJoin(F.broadcast(ends)).withColumns({c: mapped(i, c) for i, c in enumerate(columns)}).drop(*[f"_p_{i}" for i in range(len(columns))])


SCALER = "feature string, lo double, hi double"


def save_scaler(params: DataFrame, path: str) -> None:
    """The parameters as JSON lines."""
    params.select("feature", "lo", "hi").coalesce(1).write.mode("overwrite").json(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCALER).json(path)
