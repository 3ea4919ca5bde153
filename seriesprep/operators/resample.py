"""Down-sampling on each event's own time origin (W1) and gap bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesprep.operators.event_index import EventIndex, attach_events, micros, time_at
from seriesprep.operators.segments import SEGMENT_STEPS, segment_markers, with_halo
from seriesprep.schema import col


def assign_bins(samples: DataFrame, index: EventIndex, seconds: int, *columns: str) -> DataFrame:
    """Add ``t0`` and ``bin``, the left-closed interval counted from the event's first sample."""
    width = seconds * 1_000_000
    attached = attach_events(samples, index, "t0", *columns)
    return (
        attached.withColumn("_us", micros(attached, index.layout.ts))
        .filter(F.col("_us").isNotNull())
        .withColumn("bin", F.expr(f"(_us - t0) div {width}L"))
        .drop("_us")
    )


def downsample(
    samples: DataFrame, index: EventIndex, seconds: int, markers: DataFrame | None = None
) -> DataFrame:
    """Mean of each sensor and smallest label per bin.

    Grouping on (event, bin) spreads a hot event over its bins, and rows of one bin are combined
    before the shuffle, so only about one row per bin and map task moves.
    """
    layout = index.layout
    attached = index.split if markers is None else ["t1", *index.split]
    binned = assign_bins(samples, index, seconds, *attached)
    if markers is not None:
        binned = binned.unionByName(markers, allowMissingColumns=True)
    constants = ["t0", *attached, *index.code]
    return binned.groupBy(layout.key, "bin").agg(
        *[F.avg(col(s)).alias(s) for s in layout.sensors],
        F.min(col(layout.label)).alias(layout.label),
        *[F.min(col(c)).alias(c) for c in constants],
    )


def bin_start(frame: DataFrame, samples: DataFrame, index: EventIndex, seconds: int) -> DataFrame:
    """Replace ``t0`` by the bin's left edge, in the type of the samples' time column."""
    ts = index.layout.ts
    edge = time_at(F.col("t0") + F.col("bin") * F.lit(seconds * 1_000_000), samples.schema[ts].dataType)
    return frame.withColumn(ts, edge).drop("t0", "t1")


def gap_bins(bins: DataFrame, partition: list[str], values: list[str]) -> DataFrame:
    """Insert the missing bins between two rows of a partition, with null values."""
    window = W.partitionBy(*partition).orderBy("bin")
    until = F.coalesce(F.lead("bin").over(window) - 1, F.col("bin"))
    spans = bins.withColumn("_until", until)
    filled = spans.withColumn("_at", F.explode(F.sequence("bin", "_until")))
    here = F.col("_at") == F.col("bin")
    return (
        filled.withColumns({v: F.when(here, col(v)) for v in values})
        .withColumn("bin", F.col("_at"))
        .drop("_at", "_until")
    )


def resample(
    samples: DataFrame, index: EventIndex, seconds: int, size: int = SEGMENT_STEPS
) -> DataFrame:
    """W1 and W2 together: one row per bin of each event, gaps included."""
    layout = index.layout
    values = [*layout.sensors, layout.label]
    parts = index.step_partitions(seconds)
    if index.max_steps(seconds) <= size:
        bins = downsample(samples, index, seconds).repartition(parts, layout.key)
        dense = gap_bins(bins, [layout.key], values)
    else:
        markers = segment_markers(index, seconds, size, halo=0)
        cut = with_halo(downsample(samples, index, seconds, markers), "bin", size, halo=0)
        cut = cut.repartition(parts, layout.key, "_seg")
        dense = gap_bins(cut, [layout.key, "_seg"], values).drop("_seg")
    return bin_start(dense, samples, index, seconds)
