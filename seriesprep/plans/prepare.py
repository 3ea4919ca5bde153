"""From samples to standardized windows (T1, T2) and their verification."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesprep.functions.sensors import standardize, valid_sample
from seriesprep.operators.event_index import (
    EventIndex,
    index_events,
    moment_columns,
)
from seriesprep.operators.impute import impute
from seriesprep.operators.metrics import fitted_metrics
from seriesprep.operators.segments import SEGMENT_STEPS, segment_size
from seriesprep.operators.split import shuffled
from seriesprep.operators.tensor_stats import tensor_stats, tensor_summary
from seriesprep.operators.windows import sliding_windows
from seriesprep.schema import SENSOR_RANGES, SPLIT_SEED, SeriesLayout
from seriesprep.session import cut_lineage

Scaler = Mapping[str, tuple[float | None, float | None]]


def fit_scaler(index: EventIndex, k: int = 0) -> dict[str, tuple[float | None, float | None]]:
    """Mean and deviation per sensor. The index must carry moments and hold train events only."""
    means, stds = fitted_metrics(index, k)
    return {sensor: (means[sensor], stds[sensor]) for sensor in index.layout.sensors}


def windows_of(
    samples: DataFrame,
    index: EventIndex,
    scaler: Scaler,
    seconds: int,
    n: int,
    size: int = SEGMENT_STEPS,
) -> DataFrame:
    """Down-sample, impute, standardize and window the indexed events, in this order."""
    size = segment_size(n, size)
    segmented = index.max_steps(seconds) > size
    dense = impute(samples, index, seconds, halo=n - 1 if segmented else 0, size=size)
    return sliding_windows(standardize(dense, scaler, index.layout), index.layout, n, size)


def prepare_windows(
    samples: DataFrame,
    layout: SeriesLayout,
    scaler: Scaler | None,
    seconds: int,
    n: int,
    ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES,
    k: int = 0,
    size: int = SEGMENT_STEPS,
) -> DataFrame:
    """Windows of every valid event.

    One scan builds the index (anchors, validity and, without a given ``scaler``, the moments to
    fit one); a second scan makes the windows. Validity looks at the layout's sensors only.
    """
    extra = moment_columns(layout) if scaler is None else None
    index = index_events(samples, layout, ranges, extra).keep(F.col("valid"))
    return windows_of(samples, index, scaler or fit_scaler(index, k), seconds, n, size)


def prepare_split(
    samples: DataFrame,
    divided: DataFrame,
    layout: SeriesLayout,
    seconds: int,
    n: int,
    ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES,
    k: int = 0,
    size: int = SEGMENT_STEPS,
    train_layout: SeriesLayout | None = None,
) -> DataFrame:
    """Windows of all splits, standardized with the metrics of the valid train events.

    ``divided(key, split)`` has one row per event. Index and split meet event by event; the
    split never has to be joined to the windows. Every event must be valid in the layout's
    sensors; with ``train_layout``, train events must be valid in those sensors too.
    """
    strict = F.bool_and(valid_sample(train_layout or layout, ranges)).alias("strictly_valid")
    index = index_events(samples, layout, ranges, [*moment_columns(layout), strict])
    events = index.table.join(divided.select(layout.key, "split"), layout.key)
    is_train = F.col("split") == "train"
    usable = F.col("valid") & (~is_train | F.col("strictly_valid"))
    index = replace(index, table=cut_lineage(events.filter(usable)))
    scaler = fit_scaler(index.keep(is_train), k)
    return windows_of(samples, index, scaler, seconds, n, size)


def verify_windows(
    windows: DataFrame, layout: SeriesLayout, seed: int = SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """Per-event tensor statistics in shuffled event order, and their summary over events.

    The statistics are written once, so using both costs one pass over the windows.
    """
    stats = cut_lineage(tensor_stats(windows, layout))
    return shuffled(stats, layout.key, seed), tensor_summary(stats, layout)
