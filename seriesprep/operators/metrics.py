"""Global standardization metrics.

The metrics are means over events, each event weighing the same. Everything per event comes
from the moments in the event index, so the samples are read once: the deviation about a global
mean ``mu`` follows from an event's count, mean and squared deviations ``m2`` as
``m2 + n * (mean - mu)^2``, which loses no precision when ``mu`` is far from the event's mean.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesprep.operators.event_index import EventIndex
from seriesprep.operators.order_stats import trimmed_by_bounds
from seriesprep.schema import SeriesLayout, col

# Up to this k the rank filter runs as a per-task group limit before the shuffle and 2 * k rows
# per sensor are broadcast; beyond it, the k-th values are found by sketches. Same rows either way.
MAX_LISTED_TRIM = 1_000


def event_means(samples: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Mean of each sensor per event, nulls skipped."""
    return samples.groupBy(layout.key).agg(*[F.avg(col(s)).alias(s) for s in layout.sensors])


def indexed_means(index: EventIndex) -> DataFrame:
    layout = index.layout
    return index.table.select(
        layout.key, *[col(f"mean:{s}").alias(s) for s in layout.sensors]
    )


def long_form(per_event: DataFrame, layout: SeriesLayout) -> DataFrame:
    return per_event.unpivot(
        [layout.key], [col(s) for s in layout.sensors], "variable", "value"
    )


def trimmed_mean(per_event: DataFrame, layout: SeriesLayout, k: int = 0) -> DataFrame:
    """Per variable, the plain mean over events without the k smallest and k largest values.

    Ties at either end drop the events that come first by key; a row named by both ends drops
    once; a variable with nothing left has a null mean.
    """
    long = long_form(per_event, layout)
    if k == 0:
        return long.groupBy("variable").agg(F.avg("value").alias("value"))
    if k > MAX_LISTED_TRIM:
        return trimmed_by_bounds(long, k)

    def end(order: Column) -> DataFrame:
        window = W.partitionBy("variable").orderBy(order, layout.key)
        ranked = long.filter(F.col("value").isNotNull()).withColumn(
            "_rank", F.row_number().over(window)
        )
        return ranked.filter(F.col("_rank") <= k).select("variable", layout.key)

    # At most 2 * k rows per sensor.
    dropped = end(F.asc("value")).union(end(F.desc("value"))).distinct()
    marked = long.join(
        F.broadcast(dropped.withColumn("_dropped", F.lit(True))), ["variable", layout.key], "left"
    )
    return marked.groupBy("variable").agg(
        F.avg(F.when(F.col("_dropped").isNull(), F.col("value"))).alias("value")
    )


def as_mapping(per_variable: DataFrame, layout: SeriesLayout) -> dict[str, float | None]:
    """Metric of each sensor as a dict, None where no event gave one: one small row per sensor
    reaches the driver."""
    found = {row["variable"]: row["value"] for row in per_variable.collect()}
    return {sensor: found.get(sensor) for sensor in layout.sensors}


def event_stds(
    index: EventIndex, means: Mapping[str, float | None], skip_empty: bool = False
) -> DataFrame:
    """Per event, deviation of each sensor about the global mean with ``n - 1``.

    An event without values of a sensor counts as 0, and so lowers the mean deviation, unless
    ``skip_empty``. One value off the mean gives infinity, one value on it gives null.
    """
    layout = index.layout
    empty = F.lit(None).cast("double") if skip_empty else F.lit(0.0)

    def deviation(sensor: str) -> Column:
        n, mean, m2 = (col(f"{part}:{sensor}") for part in ("n", "mean", "m2"))
        mu = F.lit(means[sensor]).cast("double")
        squares = m2 + n * F.pow(mean - mu, F.lit(2.0))
        single = F.when(squares > 0, F.lit(float("inf")))
        return (
            F.when(n == 0, empty)
            .when(n == 1, single)
            .otherwise(F.sqrt(F.try_divide(squares, n - 1)))
            .alias(sensor)
        )

    return index.table.select(layout.key, *[deviation(s) for s in layout.sensors])


def metric_table(index: EventIndex, k: int = 0, skip_empty: bool = False) -> DataFrame:
    """``variable, mean_of_means, mean_of_stds``: one row per sensor."""
    layout = index.layout
    means = trimmed_mean(indexed_means(index), layout, k)
    deviations = event_stds(index, as_mapping(means, layout), skip_empty)
    stds = trimmed_mean(deviations, layout, k)
    return (
        means.withColumnRenamed("value", "mean_of_means")
        .join(stds.withColumnRenamed("value", "mean_of_stds"), "variable", "full")
    )


def fitted_metrics(
    index: EventIndex, k: int = 0
) -> tuple[dict[str, float | None], dict[str, float | None]]:
    """Both columns of the metric table as dicts, each trimmed mean computed once."""
    means = as_mapping(trimmed_mean(indexed_means(index), index.layout, k), index.layout)
    stds = as_mapping(trimmed_mean(event_stds(index, means), index.layout, k), index.layout)
    return means, stds


def scaler_of(metrics: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """Metric table as ``{sensor: (mean, std)}`` for the standardization."""
    return {
        row["variable"]: (row["mean_of_means"], row["mean_of_stds"]) for row in metrics.collect()
    }


def unusable_variables(metrics: DataFrame) -> DataFrame:
    """Sensors whose standardized column would be null throughout."""
    bad = F.col("mean_of_means").isNull() | F.col("mean_of_stds").isNull()
    return metrics.filter(bad | (F.col("mean_of_stds") == 0)).select("variable")
