"""Sliding-window tensors with folded one-hot labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesprep.functions.labels import fold_transient, one_hot
from seriesprep.operators.event_index import EventIndex
from seriesprep.operators.impute import impute
from seriesprep.operators.segments import SEGMENT_STEPS, segment_size, with_halo
from seriesprep.schema import SeriesLayout, col


def sliding_windows(
    dense: DataFrame, layout: SeriesLayout, n: int, size: int = SEGMENT_STEPS
) -> DataFrame:
    """Stride-1 windows of ``n`` consecutive bins, labelled by their last bin.

    ``dense`` holds every bin of an event. A column ``_seg`` marks it as already cut into
    segments with a halo of ``n - 1`` bins; see :func:`cut_for_windows`.
    """
    size = segment_size(n, size)
    cut = "_seg" in dense.columns
    partition = [layout.key, "_seg"] if cut else [layout.key]
    frame = W.partitionBy(*partition).orderBy("bin").rowsBetween(-(n - 1), 0)
    step = F.array(*[col(s) for s in layout.sensors])
    stacked = dense.withColumn("X", F.collect_list(step).over(frame))
    full = stacked.filter(F.col("bin") >= n - 1)  # bins are dense from 0
    if cut:
        full = full.filter(F.floor(F.col("bin") / size) == F.col("_seg"))
    constants = [c for c in (layout.code, "split") if c in dense.columns]
    label = fold_transient(col(layout.label))
    return full.select(
        layout.key,
        *[col(c) for c in constants],
        (F.col("bin") - (n - 1)).alias("window_idx"),
        "X",
        one_hot(label).alias("y"),
        label.alias("label"),
    )


def cut_for_windows(dense: DataFrame, n: int, size: int = SEGMENT_STEPS) -> DataFrame:
    """Cut a stored dense table so that long events are windowed segment by segment."""
    return with_halo(dense, "bin", segment_size(n, size), n - 1)


def event_windows(
    samples: DataFrame, index: EventIndex, seconds: int, n: int, size: int = SEGMENT_STEPS
) -> DataFrame:
    """Down-sample, impute and window the indexed events; long ones segment by segment."""
    size = segment_size(n, size)
    halo = n - 1 if index.max_steps(seconds) > size else 0
    return sliding_windows(impute(samples, index, seconds, halo, size), index.layout, n, size)


def window_counts(index: EventIndex, seconds: int, n: int) -> DataFrame:
    """Windows per event, 0 for an event shorter than one window; needs no sample."""
    steps = F.expr(f"(t1 - t0) div {seconds * 1_000_000}L + 1")
    return index.table.select(
        index.layout.key,
        steps.alias("n_bins"),
        F.greatest(steps - (n - 1), F.lit(0).cast("long")).alias("n_windows"),
    )
