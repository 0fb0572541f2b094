"""Order-dependent results over a whole table without a single-partition window.

The table is cut into buckets that follow the order; windows run inside a bucket, and what crosses from one to the next is
carried by a table with a row a bucket. The caller picks the buckets so that one fits a task and their number a single one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with name: the sum of value up to the row, in the order of bucket and then order."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = df.groupBy("_bucket").agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(before, "_bucket").withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inner), F.lit(0))).drop("_bucket", "_value", "_before")


def position(df: DataFrame, bucket: Column, order: list[Column], name: str = "position") -> DataFrame:
    """df with its row number from 1."""
    return running_total(df, bucket, order, F.lit(1).cast("long"), name)


def previous(df: DataFrame, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """df with the value of the row before, over bucket ends as well."""
    df = df.withColumn("_bucket", bucket)
    lasts = df.groupBy("_bucket").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carry = lasts.select("_bucket", F.lag("_last").over(Window.orderBy("_bucket")).alias("_carry"))
    inner = Window.partitionBy("_bucket").orderBy(*order)
    out = df.join(carry, "_bucket", "left").withColumn("_prev", F.lag(F.struct(value)).over(inner))
    return out.withColumn(name, F.coalesce("_prev", "_carry")[value]).drop("_bucket", "_carry", "_prev")


def splitters(probabilities: list[float], accuracy: int) -> list[float]:
    """Shares a little below and above each probability: twice as far as a sketch of this accuracy can be off."""
    gap = 2.0 / accuracy
    return sorted({min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-gap, gap)})


def stepped(df: DataFrame, value: str, by: list[str], probabilities: list[float], accuracy: int = 10_000) -> DataFrame:
    """by, n, _v, _step of the rows with a value (nulls and not-a-number are none): the steps lie between splitters that a mergeable sketch gives for each key, narrow ones around each probability and wide ones between."""
    own = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    at = splitters(probabilities, accuracy)
    sketch = own.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", at, accuracy).alias("_s"))
    rows = own.join(sketch, by) if by else own.crossJoin(F.broadcast(sketch))  # without a key, one row
    return rows.withColumn("_step", sum((F.col("_v") > F.col("_s")[i]).cast("int") for i in range(len(at)))).drop("_s")


def quantiles(df: DataFrame, value: str, by: list[str], probabilities: list[float], accuracy: int = 10_000) -> DataFrame:
    """by, n (rows with a value) and q: the exact quantiles of value, on the line between the two ranks beside.

    Rows are counted by step, which tells the step that each rank is in; only rows of these steps are ranked, by distinct
    value. A sketch makes the steps, so where values lie or how far an outlier is makes no difference: a step that is ranked
    holds some 4 / accuracy of a key's rows, and rows of equal value. Counts are exact, so the result is, whatever the sketch
    says. Rows with a null key are left out.
    """
    rows = stepped(df, value, by, probabilities, accuracy)
    counts = rows.groupBy(*by, "n", "_step").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*by).orderBy("_step") if by else Window.orderBy("_step")  # two steps for each probability, and one
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    sides = [x for r in rank for x in (F.floor(r), F.ceil(r))]
    here = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_n")) for r in sides]
    wanted = counts.where(reduce(lambda a, b: a | b, here)).select(*by, "_step", "_before")
    kept = rows.join(wanted, [*by, "_step"]) if by else rows.join(F.broadcast(wanted), "_step")  # a row for each rank
    kept = kept.groupBy(*by, "n", "_step", "_before", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_step").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = kept.withColumn("_upto", upto + F.col("_before"))
    at = lambda r: F.max(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r), F.col("_v")))
    found = placed.groupBy(*by, "n").agg(*[at(r).alias(f"_{i}") for i, r in enumerate(sides)])
    part = lambda i: F.col(f"_{2 * i}") + (F.col(f"_{2 * i + 1}") - F.col(f"_{2 * i}")) * (rank[i] - F.floor(rank[i]))
    return found.select(*by, "n", F.array(*[part(i) for i in range(len(rank))]).alias("q"))
