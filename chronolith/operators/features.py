"""Features of series by key, in buckets of time (see segments)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.expressions import micros
from chronolith.operators.segments import DAY_US, bucket, overlapping, own, scan


def rate_of_change(df: DataFrame, value: str, time: str, by: list[str], name: str = "rot", ties: list[str] | None = None) -> DataFrame:
    """Difference to the row before over the minutes between; null on a key's first row and where no time has passed."""
    beside = scan(df, by, [time, *(ties or [])], lags={"_v": F.col(value), "_t": micros(time)})
    return beside.withColumn(name, F.try_divide(F.col(value) - F.col("_v"), (micros(time) - F.col("_t")) / 60e6)).drop("_v", "_t")


def rolling_std(df: DataFrame, value: str, time: str, by: list[str], rows: int = 12, name: str = "roti", ties: list[str] | None = None) -> DataFrame:
    """Sample deviation over the last `rows` rows, if at least max(2, rows // 4) of them have a value."""
    blocks, series = overlapping(df, by, [time, *(ties or [])], before=rows - 1)
    frame = series.rowsBetween(1 - rows, 0)
    return own(blocks.withColumn(name, F.when(F.count(value).over(frame) >= max(2, rows // 4), F.stddev_samp(value).over(frame))))


def rate_and_spread(df: DataFrame, value: str, time: str, by: list[str], rows: int = 12, name: str = "rot", spread: str = "roti", ties: list[str] | None = None) -> DataFrame:
    """rate_of_change() and rolling_std() of it, from one look along the series."""
    blocks, series = overlapping(df, by, [time, *(ties or [])], before=rows)
    minutes = (micros(time) - F.lag(micros(time)).over(series)) / 60e6
    blocks = blocks.withColumn(name, F.try_divide(F.col(value) - F.lag(value).over(series), minutes))
    frame = series.rowsBetween(1 - rows, 0)
    return own(blocks.withColumn(spread, F.when(F.count(name).over(frame) >= max(2, rows // 4), F.stddev_samp(name).over(frame))))


def _merged(a: tuple, b: tuple) -> tuple:
    """Number, sum, mean and squared deviations of two disjoint sets of values, of many such sets side by side."""
    n, apart = a[0] + b[0], b[2] - a[2]
    some = np.maximum(n, 1)
    mean = np.where(b[0] == 0, a[2], np.where(a[0] == 0, b[2], a[2] + apart * b[0] / some))
    between = np.where((a[0] > 0) & (b[0] > 0), apart * apart * a[0] * b[0] / some, 0.0)
    return n, a[1] + b[1], mean, a[3] + b[3] + between


def _variation(at: np.ndarray, v: np.ndarray, there: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample deviation over mean of the values in each row's frame, and where there is none. at: ascending times.

    A frame is put together from one run of rows for each bit of its length; runs of twice the length come of two. So the
    work grows with n log n, and no row's value is ever taken off again.
    """
    pos, end = np.searchsorted(at, at - (span - 1), "left"), np.searchsorted(at, at, "right")
    left = end - pos
    own = np.where(there, v, 0.0)
    run = (there.astype(np.float64), own, own, np.zeros(len(v)))
    out = tuple(np.zeros(len(v)) for _ in run)
    size, most = 1, int(left.max(initial=0))
    with np.errstate(all="ignore"):
        while size <= most:
            on = np.flatnonzero(left & size)
            for total, x in zip(out, _merged(tuple(t[on] for t in out), tuple(r[pos[on]] for r in run))):
                total[on] = x
            pos[on] += size
            run = _merged(tuple(r[:-size] for r in run), tuple(r[size:] for r in run))
            size *= 2
        mean = out[1] / out[0]
        return np.sqrt(out[3] / (out[0] - 1)) / mean, (out[0] < 2) | (mean == 0)


def _varied(span: int, value: str, columns: list[str], name: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_at", "ascending")])  # rows without a time are last
        timed = len(table) - table.column("_at").null_count
        v, there = table.column(value).cast(pa.float64()), table.column(value).is_valid().to_numpy()
        v = v.fill_null(0.0).to_numpy()
        at = np.append(table.column("_at").slice(0, timed).to_numpy(), np.zeros(len(table) - timed, np.int64))
        # Rows without a time are each other's frame.
        cv, none = (np.concatenate(x) for x in zip(*(_variation(at[a:b], v[a:b], there[a:b], span) for a, b in ((0, timed), (timed, len(table))))))
        return table.select(columns).append_column(name, pa.array(cv, pa.float64(), mask=none)).filter(table.column("_own"))

    return run


def range_variation(df: DataFrame, value: str, time: str, by: list[str], span_us: int = 60_000_000, name: str = "s4_index") -> DataFrame:
    """Sample deviation over mean of the last span_us microseconds (open at the far end), between 0 and 1; null with one value or a mean of 0.

    A window's range frame would go through all its rows anew for each row, so frames are put together in tasks, a bucket of
    time at a time.
    """
    width = max(DAY_US, span_us)
    # A row also goes to the next bucket if the frames of rows there can reach it.
    last = F.floor((micros(time) + (span_us - 1)) / width)
    rows = df.withColumn("_at", micros(time)).withColumn("_in", F.explode(F.when(F.col(time).isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(bucket(time, width), last))))
    rows = rows.withColumn("_own", F.col(time).isNull() | (F.col("_in") == bucket(time, width)))
    columns = [c for c in df.columns if c != name]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema if f.name != name], T.StructField(name, T.DoubleType())])
    out = rows.groupBy(*by, "_in").applyInArrow(_varied(span_us, value, columns, name), schema)
    return out.withColumn(name, F.when(F.col(name).isNotNull(), F.least(F.greatest(name, F.lit(0.0)), F.lit(1.0))))


def rolling_mean(df: DataFrame, value: str, time: str, by: list[str], rows: int = 48, name: str = "mean_24h", ties: list[str] | None = None) -> DataFrame:
    blocks, series = overlapping(df, by, [time, *(ties or [])], before=rows - 1)
    return own(blocks.withColumn(name, F.avg(value).over(series.rowsBetween(1 - rows, 0))))


def gradient(here: Column, before: Column, after: Column, first: Column, last: Column) -> Column:
    """Half the difference of the neighbours; at the ends the difference to the one neighbour. Null for a single row."""
    return F.when(first, after - here).when(last, here - before).otherwise((after - before) / 2)


def storm(df: DataFrame, dst: str, time: str, by: list[str], onset_below: float = -50.0, ties: list[str] | None = None) -> DataFrame:
    """onset, hours_since_onset (72 before the first), gradient, phase (0 quiet, 1 initial, 2 main, 3 recovery; null without dst)."""
    order = [time, *(ties or [])]
    there = F.lit(True)
    df = scan(df, by, order, lags={"_before": F.col(dst), "_behind": there}, leads={"_after": F.col(dst), "_ahead": there})
    first, last = F.col("_behind").isNull(), F.col("_ahead").isNull()
    inside = lambda c: F.coalesce(F.col(c) <= onset_below, F.lit(False))
    df = df.withColumn("onset", inside(dst) & ~first & ~inside("_before")).withColumn("gradient", gradient(F.col(dst), F.col("_before"), F.col("_after"), first, last))
    phase = F.when(F.col(dst).isNull(), None).when(first, 0).when(F.col(dst) > onset_below, F.when(F.col("gradient") > 20, 1).otherwise(0)).otherwise(F.when(F.col("gradient") < 0, 2).otherwise(3))
    df = df.withColumn("phase", phase.cast("long")).drop("_before", "_behind", "_after", "_ahead")
    df = scan(df, by, order, lasts={"_at": F.when(F.col("onset"), micros(time))})
    return df.withColumn("hours_since_onset", F.coalesce((micros(time) - F.col("_at")) / 3.6e9, F.lit(72.0))).drop("_at")
