"""Scans over long series, a bucket of time at a time.

A window by key puts a key's whole series into one task. Here windows run in (key, bucket), and what crosses from one bucket
to the next is carried: a small table has a row for each bucket with what it hands on, a window over that table's rows sums
it up, and the result enters the bucket as a row of its own, before its first row or behind its last. So a scan moves the
rows once, one series is spread over as many tasks as it has buckets, and no join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.expressions import micros

#: Width of a bucket: a day.
DAY_US = 86_400_000_000
#: Rows of a block of overlapping().
BLOCK = 8192


def bucket(time: str, width_us: int = DAY_US) -> Column:
    return F.floor(micros(time) / width_us)


def scan(
    df: DataFrame,
    by: list[str],
    order: list[str],
    width_us: int = DAY_US,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
) -> DataFrame:
    """df with columns that look along the series of each key, in the order of `order`, whose first column is the time.

    sums: the sum up to the row. lasts: the last value up to the row that isn't null. nexts: the first value from the row on
    that isn't null. lags and leads: the value of the row before and after, null included. Rows without a time come first,
    in a bucket of their own; a null key is a key.
    """
    sums, lasts, nexts, lags, leads = (x or {} for x in (sums, lasts, nexts, lags, leads))
    # Values of neighbours are wrapped, so that a null value isn't taken for no row.
    made = {f"_{kind}_{n}": F.struct(c.alias("v")) if kind in ("lag", "lead") else c for kind, own in (("sum", sums), ("last", lasts), ("next", nexts), ("lag", lags), ("lead", leads)) for n, c in own.items()}
    at = F.struct(*order)
    rows = df.withColumns({"_bucket": bucket(order[0], width_us), **made})
    shut = lambda c: F.when(F.col(c).isNotNull(), at)
    ends = [F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in sums]
    ends += [F.max_by(c, shut(c)).alias(c) for c in (f"_last_{n}" for n in lasts)] + [F.max_by(c, at).alias(c) for c in (f"_lag_{n}" for n in lags)]
    ends += [F.min_by(c, shut(c)).alias(c) for c in (f"_next_{n}" for n in nexts)] + [F.min_by(c, at).alias(c) for c in (f"_lead_{n}" for n in leads)]
    table = rows.groupBy(*by, "_bucket").agg(*ends)
    along = Window.partitionBy(*by).orderBy("_bucket")
    back, ahead = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by).orderBy(F.desc_nulls_last("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    head = [F.sum(f"_sum_{n}").over(back).alias(f"_sum_{n}") for n in sums] + [F.last(f"_last_{n}", True).over(back).alias(f"_last_{n}") for n in lasts] + [F.lag(f"_lag_{n}").over(along).alias(f"_lag_{n}") for n in lags]
    tail = [F.last(f"_next_{n}", True).over(ahead).alias(f"_next_{n}") for n in nexts] + [F.lead(f"_lead_{n}").over(along).alias(f"_lead_{n}") for n in leads]
    both = rows.withColumn("_side", F.lit(1))
    for side, carried in ((0, head), (2, tail)):
        if carried:
            both = both.unionByName(table.select(*by, "_bucket", *carried).withColumn("_side", F.lit(side)), allowMissingColumns=True)
    inner = Window.partitionBy(*by, "_bucket").orderBy("_side", *order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    # The same rows from the end: a frame to the end of an ascending window would be gone through anew for each row.
    onward = Window.partitionBy(*by, "_bucket").orderBy(F.desc("_side"), *[F.desc_nulls_last(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.sum(f"_sum_{n}").over(upto) for n in sums} | {n: F.last(f"_last_{n}", True).over(upto) for n in lasts} | {n: F.lag(f"_lag_{n}").over(inner)["v"] for n in lags}
    out |= {n: F.last(f"_next_{n}", True).over(onward) for n in nexts} | {n: F.lead(f"_lead_{n}").over(inner)["v"] for n in leads}
    return both.withColumns({f"_out_{n}": c for n, c in out.items()}).where("_side = 1").select(*[c for c in df.columns if c not in out], *[F.col(f"_out_{n}").alias(n) for n in out])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "_row", width_us: int = DAY_US) -> DataFrame:
    """df with each row's number in its series, from 1."""
    return scan(df, by, order, width_us, sums={name: F.lit(1).cast("long")})


def overlapping(df: DataFrame, by: list[str], order: list[str], before: int = 0, after: int = 0, size: int = BLOCK, width_us: int = DAY_US) -> tuple[DataFrame, Window]:
    """df in blocks of `size` rows of a series, and a window over them: every row of a block finds `before` rows before it and `after` behind it there.

    A block holds copies of the rows around it; theirs is `_own` false, and whoever has looked around drops them, with
    own(). Any frame of at most so many rows gives what it gives over the whole series.
    """
    at = F.col("_row") - 1
    rows = numbered(df, by, order, width_us=width_us).withColumn("_blocks", F.sequence(F.greatest(F.floor((at - after) / size), F.lit(0)), F.floor((at + before) / size)))
    rows = rows.select("*", F.explode("_blocks").alias("_block")).withColumn("_own", F.col("_block") == F.floor(at / size)).drop("_blocks")
    return rows, Window.partitionBy(*by, "_block").orderBy("_row")


def own(df: DataFrame) -> DataFrame:
    """What overlapping() was given, with the columns that were added since."""
    return df.where("_own").drop("_own", "_block", "_row")
