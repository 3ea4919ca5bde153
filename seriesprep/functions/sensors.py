"""Per-sample sensor expressions: units, ranges, missing values, standardization."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesprep.schema import (
    NUM_CLASSES,
    TRANSIENT_LABELS,
    UNIT_BY_INITIAL,
    SeriesLayout,
    col,
)


def sensor_unit(variable: Column) -> Column:
    unit = F.lit("")
    for initial, text in UNIT_BY_INITIAL.items():
        unit = F.when(variable.startswith(initial), text).otherwise(unit)
    return unit


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def missing_to_null(samples: DataFrame, layout: SeriesLayout) -> DataFrame:
    """NaN means "missing" in recordings, but is a value to Spark: drop it once, on ingest."""
    names = [n for n in (*layout.sensors, layout.label) if n in samples.columns]
    return samples.withColumns({n: nan_to_null(col(n).cast("double")) for n in names})


def known_label(label: Column) -> Column:
    """Null, a steady class 0-8 or a transient class 101-108."""
    y = F.coalesce(label, F.lit(0.0))
    return y.between(0, NUM_CLASSES - 1) | y.between(*TRANSIENT_LABELS)


def valid_sample(
    layout: SeriesLayout, ranges: Mapping[str, tuple[float, float]]
) -> Column:
    """True when time, label and every sensor of the layout are acceptable; null values are."""
    checks = [F.coalesce(col(s), F.lit(0.0)).between(*ranges[s]) for s in layout.sensors]
    checks += [col(layout.ts).isNotNull(), known_label(col(layout.label))]
    return reduce(lambda a, b: a & b, checks)


def standardize(
    frame: DataFrame, scaler: Mapping[str, tuple[float | None, float | None]], layout: SeriesLayout
) -> DataFrame:
    """``(x - mean) / std`` for each sensor of the layout.

    A zero or unknown deviation gives null instead of the infinities a plain division would
    give, and so does a sensor without a mean.
    """

    def scaled(name: str) -> Column:
        mean, std = scaler[name]
        shifted = col(name) - F.lit(mean).cast("double")
        return F.try_divide(shifted, F.lit(std).cast("double"))

    return frame.withColumns({s: scaled(s) for s in layout.sensors})
