"""Verification of forecasts. Pairs with a null are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.expressions import clip
from chronolith.operators.ordered import running_total
from chronolith.operators.segments import overlapping
from chronolith.operators.segments import own as own_rows

EPS = 1e-9


def complete(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """The rows that are verified. What depends on the row before, as the skill does, is taken after this."""
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())


def regression(df: DataFrame, truth: str, pred: str, by: list[str] | None = None, before: str | None = None) -> DataFrame:
    """mae, rmse, mbe, r2, and with `before` (the truth of the row before, in complete(df)) the skill against it."""
    own = complete(df, truth, pred)
    e, n = F.col(pred) - F.col(truth), F.count("*")
    rmse = F.sqrt(F.avg(e * e))
    out = [F.avg(F.abs(e)).alias("mae"), rmse.alias("rmse"), F.avg(e).alias("mbe"), (1 - F.sum(e * e) / (F.var_pop(truth) * n + EPS)).alias("r2"), n.alias("n")]
    if before:
        d = F.col(truth) - F.col(before)
        out.append(F.when(n > 1, 1 - rmse / (F.sqrt(F.avg(d * d)) + EPS)).otherwise(0.0).alias("skill"))
    grouped = own.groupBy(*by) if by else own.groupBy()
    out = grouped.agg(*out)
    return out if by else out.where("n > 0")


def contingency(df: DataFrame, truth: str, pred: str, thresholds: Column, by: list[str] | None = None) -> DataFrame:
    """By level of `thresholds` (an array of (level, threshold)): n_events, f1, precision, recall, pod, far, csi; these are null where the truth has no event."""
    by = by or []
    own = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(*by, truth, pred, F.inline(thresholds))
    t, p = F.col(truth) >= F.col("threshold"), F.col(pred) >= F.col("threshold")
    c = own.groupBy(*by, "level").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    some = lambda x: F.when(tp + fn > 0, F.coalesce(x, F.lit(0.0)))
    return c.select(
        *by, "level", (tp + fn).alias("n_events"), some(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), some(F.try_divide(tp, tp + fp)).alias("precision"), some(F.try_divide(tp, tp + fn)).alias("recall"),
        some(tp / (tp + fn + EPS)).alias("pod"), some(fp / (tp + fp + EPS)).alias("far"), some(tp / (tp + fp + fn + EPS)).alias("csi"),
    )


def level_aucs(df: DataFrame, truth: str, pred: str, thresholds: Column) -> DataFrame:
    """(level, auc) of every level in one pass: the running count goes on from level to level, and what came before a level is taken off."""
    own = complete(df, truth, pred).select(truth, F.col(pred).alias("score"), F.posexplode(thresholds).alias("i", "l")).select(truth, "score", "i", "l.*")
    own = own.groupBy("i", "level", "score").agg(F.count_if(F.col(truth) >= F.col("threshold")).alias("pos"), F.count_if(F.col(truth) < F.col("threshold")).alias("neg"))
    below = running_total(own, F.struct("i", F.floor(F.col("score") * 1000).alias("step")), [F.col("score")], F.col("neg"), "upto")
    sums = below.groupBy("level").agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("wins"), F.min(F.col("upto") - F.col("neg")).alias("base"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select("level", F.try_divide(F.col("wins") - F.col("pos") * F.col("base"), (F.col("pos") * F.col("neg")).cast("double")).alias("auc"))


def suite(df: DataFrame, truth: str, pred: str, before: str, time: str, by: list[str], thresholds: Column, warning: float, most_steps: int, minutes: int) -> DataFrame:
    """The whole validation as (section, level, metric, value): regression, events by level with their AUC, lead times, targets (1 where met).

    Predictions are held in [0, 1] first, as an index of scintillation is.
    """
    df = df.withColumn(pred, clip(F.col(pred), 0.0, 1.0))

    def stacked(row: DataFrame, section: str, metrics: list[str], level: Column | None = None) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return row.select(F.lit(section).alias("section"), (F.lit("") if level is None else level).alias("level"), F.inline(pairs))

    metrics = regression(df, truth, pred, before=before)
    levels = contingency(df, truth, pred, thresholds).join(level_aucs(df, truth, pred, thresholds), "level")
    leads = lead_times(df, truth, pred, time, by, warning, most_steps, minutes)
    f1 = levels.agg(*[F.max(F.when(F.col("level") == x, F.col("f1"))).alias(f"f1_{x}") for x in ("warning", "severe")])  # one row
    targets = compliance(metrics.crossJoin(F.broadcast(f1)))
    out = stacked(metrics, "regression", ["mae", "rmse", "mbe", "r2", "n", "skill"])
    out = out.unionByName(stacked(levels, "events", ["n_events", "f1", "precision", "recall", "pod", "far", "csi", "auc"], F.col("level")))
    out = out.unionByName(stacked(leads, "lead_time", ["mean_lead", "median_lead", "n_leads", "n_events"]))
    return out.unionByName(targets.select(F.lit("targets").alias("section"), F.lit("").alias("level"), "metric", F.col("passed").cast("double").alias("value")))


def auc(df: DataFrame, truth: str, pred: str, threshold: float, bucket: Column | None = None) -> DataFrame:
    """One row: the area under the curve for truth >= threshold, ties counted half; null if a class is missing.

    Rows are first summed by distinct score; the running count of negatives is carried over buckets of scores.
    """
    own = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(pred).alias("score")).agg(F.count_if(F.col(truth) >= threshold).alias("pos"), F.count_if(F.col(truth) < threshold).alias("neg"))
    below = running_total(own, F.floor(F.col("score") * 1000) if bucket is None else bucket, [F.col("score")], F.col("neg"), "upto")
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return below.agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def lead_times(df: DataFrame, truth: str, pred: str, time: str, by: list[str], threshold: float, most_steps: int, minutes: int) -> DataFrame:
    """One row: mean_lead, median_lead, n_leads, n_events. A lead is how long before an up-crossing of the truth the forecast, at most most_steps back, was first at the threshold."""
    blocks, series = overlapping(df.select(*by, time, truth, pred), by, [time], before=max(1, most_steps))
    on = F.coalesce(F.col(truth) >= threshold, F.lit(False))
    onset = on & ~F.coalesce(F.lag(on).over(series), F.lit(True))
    back = F.coalesce(*[F.when(F.lag(pred, k).over(series) >= threshold, k * minutes) for k in range(most_steps, 0, -1)])
    own = own_rows(blocks.withColumn("_onset", onset).withColumn("_lead", back.cast("double"))).where("_onset")
    return own.agg(F.coalesce(F.avg("_lead"), F.lit(0.0)).alias("mean_lead"), F.coalesce(F.percentile("_lead", 0.5), F.lit(0.0)).alias("median_lead"), F.count("_lead").alias("n_leads"), F.count("*").alias("n_events"))


def skill(model: Column, reference: Column) -> Column:
    return 1 - F.try_divide(model, reference)


def combined_loss(truth: Column, pred: Column, mse: float = 0.7, mae: float = 0.3) -> Column:
    """Aggregate: 0 for no pair."""
    e = pred - truth
    return F.coalesce(mse * F.avg(e * e) + mae * F.avg(F.abs(e)), F.lit(0.0))


def focal_loss(truth: Column, pred: Column, gamma: float = 2.0, weight: float = 3.0, severe: float = 0.7) -> Column:
    e = F.abs(pred - truth)
    return F.coalesce(F.avg(F.pow(1 + e, F.lit(gamma)) * F.when(truth >= severe, weight).otherwise(1.0) * e * e), F.lit(0.0))


def compliance(metrics: DataFrame) -> DataFrame:
    """(metric, value, target, passed) of one row of mae, rmse, f1_warning, f1_severe."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target"), (F.col(m) < t if below else F.col(m) > t).alias("passed")) for m, t, below in (("mae", 0.08, True), ("rmse", 0.12, True), ("f1_warning", 0.85, False), ("f1_severe", 0.80, False))]
    return metrics.select(F.inline(F.array(*rows)))
