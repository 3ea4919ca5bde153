"""Sanity statistics over stored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesprep.schema import NUM_CLASSES, SeriesLayout


def tensor_stats(windows: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Per event: min and max of each sensor over windows and steps, share of each class.

    Every window has the same number of steps, so a class has the same share of the unrolled
    steps as of the windows.
    """
    steps = windows.select(layout.key, "label", F.explode("X").alias("step"))
    per_sensor = []
    for i, sensor in enumerate(layout.sensors):
        value = F.get("step", F.lit(i))
        per_sensor += [F.min(value).alias(f"min:{sensor}"), F.max(value).alias(f"max:{sensor}")]
    shares = [
        F.avg((F.col("label") == c).cast("double")).alias(f"share:{c}") for c in range(NUM_CLASSES)
    ]
    return steps.groupBy(layout.key).agg(*per_sensor, *shares)


def tensor_summary(stats: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Smallest, mean and largest value, and the sum, of each per-event statistic over events."""
    names = [c for c in stats.columns if c != layout.key]
    long = stats.unpivot([], [F.col(f"`{c}`") for c in names], "statistic", "value")
    return long.groupBy("statistic").agg(
        F.min("value").alias("smallest"),
        F.avg("value").alias("average"),
        F.max("value").alias("largest"),
        F.sum("value").alias("total"),
    )
