"""Predicted events against true ones: matching, per-video metrics, macro means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.operators.folds import match_one_to_one
from chalkline.operators.joins import within


def match_events(predicted: DataFrame, truth: DataFrame, keys: list[str], tolerance_s: float) -> DataFrame:
    """One-to-one matches (keys, `p`, `g`, `d`): pairs at most `tolerance_s` apart, nearest first, each event used once.

    predicted has keys and `p`, truth keys and `g` (times). Pairs are made by shard of the clock; the greedy choice runs
    over pieces of a key's pairs that share no event.
    """
    spans = truth.where("g is not null").select(*keys, "g", (F.col("g") - tolerance_s).alias("_lo"), (F.col("g") + tolerance_s).alias("_hi"))
    pairs = within(predicted.where("p is not null").select(*keys, "p"), spans, keys, "p", "_lo", "_hi").withColumn("d", F.abs(F.col("p") - F.col("g")))
    return match_one_to_one(pairs.where(F.col("d") <= tolerance_s).select(*keys, "p", "g", "d"), "p", "g", "d", keys, tolerance_s)


def metrics_by_key(predicted: DataFrame, truth: DataFrame, keys: list[str], tolerance_s: float) -> DataFrame:
    """Per key: counts, precision, recall, f1, missed and false rates, mean and median error; 0 where undefined."""
    matched = match_events(predicted, truth, keys, tolerance_s).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matched"), F.avg("d").alias("mean_error"), F.expr("percentile(d, 0.5)").alias("median_error")
    )
    counts = predicted.where("p is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("predicted")).join(
        truth.where("g is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("true")), keys, "full"
    )
    c = F.col
    rows = counts.join(matched, keys, "left").select(
        *keys, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("predicted", "true", "matched")],
        *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("mean_error", "median_error")],
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns({"precision": share(c("matched"), c("predicted")), "recall": share(c("matched"), c("true"))})
    return rows.withColumns(
        {
            "f1": share(2 * c("precision") * c("recall"), c("precision") + c("recall")),
            "missed_rate": share(c("true") - c("matched"), c("true")),
            "false_rate": share(c("predicted") - c("matched"), c("predicted")),
        }
    )


def macro(metrics: DataFrame) -> DataFrame:
    """Means of the ratios and errors over the keys, sums of the counts: one row."""
    ratios = ("precision", "recall", "f1", "missed_rate", "false_rate", "mean_error", "median_error")
    return metrics.agg(F.count(F.lit(1)).alias("videos"), *[F.avg(x).alias(x) for x in ratios], *[F.sum(x).alias(x) for x in ("predicted", "true", "matched")])
