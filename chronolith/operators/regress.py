"""Linear scorers of several features, by group: least squares from sums that one aggregate makes, bootstrap members, forecasts with the members' spread."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from chronolith.functions.expressions import clip
from chronolith.operators.forecast import rollout

#: Shares below which a number of [0, 1) stands for 0, 1, 2, ... draws of a row: a Poisson distribution of mean 1.
DRAWS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def complete(x: Column, y: Column) -> Column:
    """Whether a row can be fitted: y and all of x are there."""
    return y.isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull())


def normal_equations(rows: DataFrame, by: list[str], x: str, k: int, y: str, weight: Column | None = None) -> DataFrame:
    """by, n (the weights' sum), gram and cross: the sums of products of the k features and 1 with each other (upper triangle, row by row) and with y. Tasks add up before anything moves, so a group's rows never meet."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    v = [F.get(x, F.lit(i)) for i in range(k)] + [F.lit(1.0)]
    sums = [F.sum(w * v[i] * v[j]) for i in range(k + 1) for j in range(i, k + 1)]
    own = rows.where(complete(F.col(x), F.col(y)))
    return own.groupBy(*by).agg(F.sum(w).alias("n"), F.array(*sums).alias("gram"), F.array(*[F.sum(w * u * F.col(y)) for u in v]).alias("cross"))


def _solver(names: list[str], k: int, ridge: float):
    place = np.triu_indices(k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for upper, cross in zip(b.column("gram").to_pylist(), b.column("cross").to_pylist()):
                gram = np.zeros((k + 1, k + 1))
                gram[place] = upper
                gram += np.triu(gram, 1).T
                gram[np.arange(k), np.arange(k)] += ridge
                # Features are brought to one size first; what they can't tell apart gets the smallest coefficients.
                size = np.sqrt(np.diag(gram))
                size[size == 0] = 1
                out.append(np.linalg.lstsq(gram / np.outer(size, size), np.array(cross) / size, rcond=1e-11)[0] / size)
            own = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array([c[:k].tolist() for c in out], pa.list_(pa.float64())), pa.array([float(c[k]) for c in out], pa.float64())], [*names, "coefficients", "intercept"])

    return run


def fit(rows: DataFrame, by: list[str], x: str, k: int, y: str, weight: Column | None = None, ridge: float = 0.0) -> DataFrame:
    """by, n, coefficients (of the array x of k features) and intercept of each group's least squares; ridge is added for the coefficients' squares.

    Rows with a null in x or y are left out; a group without others has no row. One pass over the rows, and a system of
    k + 1 equations for each group, in tasks.
    """
    sums = normal_equations(rows, by, x, k, y, weight)
    names = [*by, "n"]
    schema = StructType([f for f in sums.schema if f.name in names]).add("coefficients", ArrayType(DoubleType())).add("intercept", DoubleType())
    return sums.mapInArrow(_solver(names, k, ridge), schema)


def score(x: Column, coefficients: Column, intercept: Column) -> Column:
    return F.aggregate(F.zip_with(x, coefficients, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + intercept


def bootstrap(rows: DataFrame, identity: list[Column], members: int, seed: int = 0) -> DataFrame:
    """rows for each member (from 0) that draws them, with `draws`: how often. A row's draws follow from seed, member and its identity, so a task that runs again draws the same."""
    out = rows.withColumn("member", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(members - 1).cast("long"))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("member").cast("string"), *[c.cast("string") for c in identity]).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return out.withColumn("draws", sum((u >= d).cast("long") for d in DRAWS)).where("draws > 0")


def rollout_ensemble(samples: DataFrame, models: DataFrame, x: str, keys: list[str], steps: int) -> DataFrame:
    """keys, forecast_step, s4_forecast, std, s4_lower, s4_upper: every sample rolled out by every model, then the members' mean, their deviation, and the bounds of 95 % that it gives. models: coefficients and intercept, a row for each of a few members, which is broadcast."""
    met = samples.select(*keys, x).crossJoin(F.broadcast(models.select("coefficients", "intercept")))
    paths = rollout(met, x, F.col("coefficients"), F.col("intercept"), steps)
    out = paths.groupBy(*keys, "forecast_step").agg(F.avg("s4_forecast").alias("s4_forecast"), F.stddev_pop("s4_forecast").alias("std"))
    reach = 1.96 * F.col("std")
    return out.withColumns({"s4_lower": clip(F.col("s4_forecast") - reach, 0.0, 1.0), "s4_upper": clip(F.col("s4_forecast") + reach, 0.0, 1.0)})


def cross_validate(rows: DataFrame, x: str, k: int, y: str, fold: str, held: str, ridge: float = 0.0) -> DataFrame:
    """By fold of `rows` (fold, held, x, y): coefficients and intercept fitted on what isn't held out, and mae, rmse, r2 and n on what is. All folds are fitted by one aggregate; a fold without rows on either side has no row."""
    fits = fit(rows.where(~F.col(held)), [fold], x, k, y, ridge=ridge).select(fold, "coefficients", "intercept")
    own = rows.where(F.col(held) & complete(F.col(x), F.col(y))).join(fits, fold)
    e = score(F.col(x), F.col("coefficients"), F.col("intercept")) - F.col(y)
    out = own.groupBy(fold, "coefficients", "intercept").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"), F.count("*").alias("n"))
    return out
