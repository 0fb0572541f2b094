"""Samples, splits, folds, and forecasts that need no network: persistence, linear rollout, ensembles."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.ordered import position
from chronolith.operators.segments import overlapping, own


def windows(df: DataFrame, value: str, time: str, by: list[str], steps: int = 12) -> DataFrame:
    """by, time, x (the `steps` values before), y, mask (whether y is there); nulls are 0 in x and y. Rows with fewer before them have no sample."""
    blocks, series = overlapping(df, by, [time], before=steps)
    filled = F.coalesce(F.col(value), F.lit(0.0))
    return own(blocks.withColumn("x", F.collect_list(filled).over(series.rowsBetween(-steps, -1))).withColumn("y", filled).withColumn("mask", F.col(value).isNotNull())).where(F.size("x") == steps)


def temporal_split(time: Column, train_end: Column, val_end: Column) -> Column:
    return F.when(time <= train_end, "train").when(time <= val_end, "val").otherwise("test")


def fraction_split(df: DataFrame, bucket: Column, order: list[Column], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """df with split by the row's place in the order: the first int(train n) rows, then up to int((train + val) n), then the rest."""
    n = df.agg(F.count("*").alias("_n"))  # one row
    placed = position(df, bucket, order, "_at").crossJoin(F.broadcast(n))
    upto = F.floor(F.lit(train) * F.col("_n")), F.floor(F.lit(train + val) * F.col("_n"))
    return placed.withColumn("split", F.when(F.col("_at") <= upto[0], "train").when(F.col("_at") <= upto[1], "val").otherwise("test")).drop("_at", "_n")


def temporal_folds(df: DataFrame, time: str, folds: int, val_months: int) -> DataFrame:
    """(fold, val_start, val_end, n_train, n_val) of folds that train on all before val_start; those beyond the data or with an empty side are left out.

    Times are counted by day before they meet the folds, so the range join has a row a day.
    """
    days = df.groupBy(F.to_date(time).alias("d")).agg(F.count("*").alias("n"))
    ends = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    months = (F.year("hi") - F.year("lo")) * 12 + F.month("hi") - F.month("lo")
    step = F.greatest(F.lit(val_months), F.floor(months / (folds + 1)).cast("int"))
    plan = ends.select("lo", "hi", step.alias("step"), F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    plan = plan.withColumn("val_start", F.add_months(F.to_date("lo"), F.col("fold") * F.col("step"))).withColumn("val_end", F.add_months("val_start", val_months)).where("cast(val_end as timestamp_ntz) <= hi")
    met = days.join(F.broadcast(plan), F.col("d") < F.col("val_end"))
    out = met.groupBy("fold", "val_start", "val_end").agg(F.sum(F.when(F.col("d") < F.col("val_start"), F.col("n")).otherwise(0)).alias("n_train"), F.sum(F.when(F.col("d") >= F.col("val_start"), F.col("n")).otherwise(0)).alias("n_val"))
    return out.where("n_train > 0 and n_val > 0")


def spatial_folds(stations: DataFrame, folds: int, fraction: float) -> DataFrame:
    """(fold, id, held_out): in each fold the next max(1, int(n fraction)) stations in order, round the end."""
    n = stations.agg(F.count("*").alias("n"))
    placed = position(stations.select("id"), F.floor(F.col("id") / 1000), [F.col("id")], "at").crossJoin(F.broadcast(n))
    hold = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * F.lit(fraction)))
    rows = placed.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    return rows.select("fold", "id", (F.pmod(F.col("at") - 1 - F.pmod(F.col("fold") * hold, F.col("n")), F.col("n")) < hold).alias("held_out"))


def persistence(df: DataFrame, value: str, steps: int, minutes: int) -> DataFrame:
    """The last value for every lead: df's rows with forecast_step, lead_time_min and s4_forecast."""
    return df.withColumn("forecast_step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long")))).withColumn("lead_time_min", F.col("forecast_step") * minutes).withColumn("s4_forecast", F.col(value))


def pairs_at_leads(df: DataFrame, value: str, time: str, by: list[str], steps: int) -> DataFrame:
    """(step, y_true, y_pred) of persistence: the value `step` rows later against the value now."""
    blocks, series = overlapping(df.select(*by, time, value), by, [time], after=steps)
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("step"), F.lead(value, k).over(series).alias("y_true"), F.col(value).alias("y_pred")) for k in range(1, steps + 1)])
    return own(blocks.withColumn("_rows", rows)).select(*by, F.inline("_rows")).where("y_true is not null and y_pred is not null")


def rollout(samples: DataFrame, x: str, coefficients: list[float] | Column, intercept: float | Column, steps: int, std: float = 0.0) -> DataFrame:
    """Recursive forecast of a linear model over the window in x: forecast_step, s4_forecast, s4_lower, s4_upper.

    Each step's clipped value joins the window, whose oldest goes; std gives the bounds of 95 %. A model is given in numbers
    or by columns of the samples.
    """
    w = coefficients if isinstance(coefficients, Column) else F.array(*[F.lit(float(c)) for c in coefficients])
    n = F.size(w)

    def step(state: Column, _: Column) -> Column:
        window = F.slice(state, -n, n)
        value = F.aggregate(F.zip_with(window, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + intercept
        return F.concat(state, F.array(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col(x), step)
    out = samples.withColumn("_path", F.slice(path, -steps, steps)).select(*[c for c in samples.columns if c != x], F.posexplode("_path").alias("_i", "s4_forecast"))
    bound = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return out.withColumns({"forecast_step": F.col("_i").cast("long") + 1, "s4_lower": bound(F.col("s4_forecast") - 1.96 * std), "s4_upper": bound(F.col("s4_forecast") + 1.96 * std)}).drop("_i")


def ensemble(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and both deviations over members: std_dropout of a sample, std_members of the whole."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_dropout"), F.stddev_pop(value).alias("std_members"), F.count(value).alias("n"))


def fit_linear(samples: DataFrame, x: str, y: str, mask: str) -> tuple[list[float], float]:
    """Coefficients and intercept of the linear scorer of rollout(), by least squares over all samples whose target is there."""
    own = samples.where(F.col(mask)).select(array_to_vector(x).alias("features"), F.col(y).cast("double").alias("label"))
    model = LinearRegression(solver="normal", standardization=False).fit(own)
    return [float(c) for c in model.coefficients], float(model.intercept)


def cross_validate(rows: DataFrame, x: str, y: str, fold: str, held: str) -> DataFrame:
    """By fold of `rows` (fold, held, x, y): slope and intercept of a one-feature scorer fitted on what isn't held out, and its mae, rmse and n on what is.

    The fits are aggregates of all folds at once. A fold that can't be fitted, or holds nothing out, has no row.
    """
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fits = own.where(~F.col(held)).groupBy(fold).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).where("slope is not null")
    e = F.col("slope") * F.col(x) + F.col("intercept") - F.col(y)
    return own.where(F.col(held)).join(fits, fold).groupBy(fold, "slope", "intercept").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def over_folds(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std) over the folds of cross_validate()."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    return scores.select(F.inline(rows)).groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def lead_summary(leads: DataFrame, step: str, metrics: list[str], minutes: int) -> DataFrame:
    """step, lead_time_min and the metrics of each lead, and a row of their means over the leads that have one, whose step is null."""
    each = leads.select(F.col(step).cast("long").alias(step), (F.col(step) * minutes).cast("long").alias("lead_time_min"), *metrics)
    means = each.agg(*[F.avg(m).alias(m) for m in metrics])
    return each.unionByName(means, allowMissingColumns=True)
