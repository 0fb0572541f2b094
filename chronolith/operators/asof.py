"""As-of joins with a tolerance.

Time is cut into buckets as wide as the tolerance or wider. A left row is in one bucket, a right row in its own and in
those that it may serve; a window by key and bucket then finds the neighbours. So work is spread over keys and times, with
no key at all as well, and no pair is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.expressions import micros


def asof_join(left: DataFrame, right: DataFrame, time: str, payload: list[str], tolerance_us: int, by: list[str] | None = None, direction: str = "nearest", sequence: str | None = None, bucket_us: int | None = None) -> DataFrame:
    """left with the payload of the right row that is nearest in time, at most tolerance_us away, or nulls.

    direction: "nearest" (of equally near rows the earlier) or "backward" (at or before). Of right rows at one time the last
    in `sequence` counts. A row is chosen as a whole: nulls in its payload stay. Rows without a time match nothing.
    """
    by = by or []
    width = max(bucket_us or 0, tolerance_us, 1)
    own = [c for c in left.columns if c not in (*by, time)]
    clash = set(own) & set(payload)
    if clash:
        raise ValueError(f"payload columns are in the left table: {sorted(clash)}")
    seq = F.col(sequence) if sequence else F.lit(0)
    at = micros(time)
    kinds = {f.name: f.dataType for f in left.schema}
    nothing = F.lit(None)
    right_struct = F.struct(at.alias("at"), *payload)
    kind = right.select(right_struct.alias("r")).schema["r"].dataType
    l = left.select(*by, F.floor(at / width).alias("_b"), at.alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(right.select(seq.alias("s")).schema["s"].dataType).alias("_seq"), F.struct(time, *own).alias("_l"), nothing.cast(kind).alias("_r"))
    first = F.floor(at / width) if direction == "backward" else F.floor((at - tolerance_us) / width)
    served = F.sequence(first, F.floor((at + tolerance_us) / width))
    r = right.where(F.col(time).isNotNull()).select(*by, F.explode(served).alias("_b"), at.alias("_at"), F.lit(1).alias("_side"), seq.alias("_seq"), nothing.cast(l.schema["_l"].dataType).alias("_l"), right_struct.alias("_r"))
    both = l.unionByName(r)
    part = Window.partitionBy(*by, "_b")
    back = part.orderBy("_at", F.desc("_side"), "_seq").rowsBetween(Window.unboundedPreceding, 0)
    # From the end, as a frame to the end of an ascending window would be gone through anew for each row.
    ahead = part.orderBy(F.desc("_at"), F.desc("_side"), "_seq").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_p", F.last("_r", True).over(back))
    if direction == "nearest":
        both = both.withColumn("_n", F.last("_r", True).over(ahead))
        before, after = F.col("_at") - F.col("_p.at"), F.col("_n.at") - F.col("_at")
        both = both.withColumn("_p", F.when(after.isNull() | (before <= after), F.col("_p")).otherwise(F.col("_n")))
    hit = F.abs(F.col("_at") - F.col("_p.at")) <= tolerance_us
    out = both.where("_side = 0").withColumn("_p", F.when(hit, F.col("_p")))
    return out.select(*by, *[F.col(f"_l.{c}").cast(kinds[c]).alias(c) for c in (time, *own)], *[F.col(f"_p.{c}").alias(c) for c in payload])
