"""Event validity (P4, P5, J7) and flow-state series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesprep.functions.sensors import sensor_unit, valid_sample
from seriesprep.operators.event_index import EventIndex, attach_events, keep_events
from seriesprep.schema import PERMANENT_LABELS, TRANSIENT_LABELS, SeriesLayout, col


def event_validity(
    samples: DataFrame, layout: SeriesLayout, ranges: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """One row per event: valid only if every one of its samples is."""
    return samples.groupBy(layout.key).agg(
        F.bool_and(valid_sample(layout, ranges)).alias("valid")
    )


def drop_invalid_events(samples: DataFrame, index: EventIndex) -> DataFrame:
    """Samples of the valid events; the index must have been built with ranges."""
    return keep_events(samples, index.keep(F.col("valid")))


def samples_of_invalid_events(samples: DataFrame, index: EventIndex) -> DataFrame:
    """Samples of events that are not valid (anti join against the valid ones, J7)."""
    layout = index.layout
    valid = index.table.filter(F.col("valid")).select(layout.key)
    if index.fits_broadcast(1):
        valid = F.broadcast(valid)
    return samples.join(valid, layout.key, "left_anti")


def flow_state(samples: DataFrame, index: EventIndex) -> DataFrame:
    """Five masked series per sensor, one output row per sample and sensor.

    ``no_data`` carries the sensor's minimum over the event, taken from the index
    (``minimum_columns``), where the value is missing.
    """
    layout = index.layout
    minima = [f"min:{s}" for s in layout.sensors]
    label = col(layout.label)

    def series(sensor: str) -> Column:
        value = col(sensor)
        return F.struct(
            F.lit(sensor).alias("variable"),
            F.when(label == 0, value).alias("normal"),
            F.when(label.between(*TRANSIENT_LABELS), value).alias("transient"),
            F.when(label.between(*PERMANENT_LABELS), value).alias("permanent"),
            F.when(label.isNull(), value).alias("unknown"),
            F.when(value.isNull(), col(f"min:{sensor}")).alias("no_data"),
        )

    long = attach_events(samples, index, *minima).select(
        layout.key, layout.ts, F.explode(F.array(*[series(s) for s in layout.sensors])).alias("s")
    )
    return long.select(layout.key, layout.ts, "s.*").withColumn("unit", sensor_unit(col("variable")))
