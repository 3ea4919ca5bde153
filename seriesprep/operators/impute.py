"""Filling of resampled events (W2, W3, W4) and the interpolation overlay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesprep.operators.event_index import EventIndex, keep_events
from seriesprep.operators.resample import bin_start, downsample
from seriesprep.operators.scan import known_neighbours, whole_groups
from seriesprep.operators.segments import (
    SEGMENT_STEPS,
    neighbours,
    segment_carry,
    segment_markers,
    with_halo,
)
from seriesprep.schema import SeriesLayout, col
from seriesprep.session import cut_lineage

# Raw rows of one event that may share a task, and be in its memory, before the event is
# range-partitioned.
SEGMENT_ROWS = 262_144


def on_line(at: Column, name: str) -> Column:
    """Value at position ``at`` between the two known neighbours; null if one is missing."""
    prev_pos, prev_val = col(f"prev_pos:{name}"), col(f"prev_val:{name}")
    share = F.try_divide(at - prev_pos, col(f"next_pos:{name}") - prev_pos)
    return prev_val + (col(f"next_val:{name}") - prev_val) * share


def impute(
    samples: DataFrame,
    index: EventIndex,
    seconds: int,
    halo: int = 0,
    size: int = SEGMENT_STEPS,
) -> DataFrame:
    """Down-sample, then give every bin of every event a value for each sensor and the label.

    Sensors: linear inside gaps, last value after the end, first value before the start, 0 when
    the event has none. Label: last known, else next known, else the event's class code.

    Neighbours are found on the bins that exist; the missing bins are produced afterwards, so
    they pass through no sort. With ``halo`` set, a column ``_seg`` tells the segments apart and
    each one starts with the last ``halo`` bins of the one before.
    """
    layout = index.layout
    values = [*layout.sensors, layout.label]
    if index.max_steps(seconds) <= size:
        bins, partition, carry = downsample(samples, index, seconds), [layout.key], None
    else:
        size = max(size, halo + 1)  # as segment_size
        # Three consumers below: written once, so a lost executor costs no second raw scan.
        sparse = cut_lineage(
            downsample(samples, index, seconds, segment_markers(index, seconds, size, halo))
        )
        width = seconds * 1_000_000
        long_events = sparse.filter(F.expr(f"(t1 - t0) div {width}L >= {size}"))
        carry = segment_carry(
            long_events.withColumn("_seg", F.floor((F.col("bin") + halo) / size)),
            long_events.withColumn("_seg", F.floor(F.col("bin") / size)),
            layout.key,
            "bin",
            values,
            index.max_steps(seconds) // size + 2,
        )
        bins, partition = with_halo(sparse, "bin", size, halo), [layout.key, "_seg"]

    bins = bins.repartition(index.step_partitions(seconds), *partition)
    following_bin = F.lead("bin").over(W.partitionBy(*partition).orderBy("bin"))
    spans = bins.withColumn("_until", F.coalesce(following_bin - 1, F.col("bin")))
    known = neighbours(spans, partition, "bin", values, carry)
    at = known.withColumn("_at", F.explode(F.sequence("bin", "_until")))

    def filled(name: str) -> Column:
        ends = (col(f"prev_val:{name}"), col(f"next_val:{name}"))
        return F.coalesce(on_line(F.col("_at"), name), *ends, F.lit(0.0))

    label = F.coalesce(
        col(f"prev_val:{layout.label}"),
        col(f"next_val:{layout.label}"),
        col(layout.code).cast("double"),
    )
    dense = at.select(
        *partition,
        F.col("_at").alias("bin"),
        "t0",
        *[filled(s).alias(s) for s in layout.sensors],
        label.alias(layout.label),
        col(layout.code),
        *index.split,
    )
    dense = bin_start(dense, samples, index, seconds)
    return dense.drop("_seg") if halo == 0 else dense


def number_long_events(samples: DataFrame, layout: SeriesLayout, parts: int) -> DataFrame:
    """Add ``pos``, the row position within the event, and ``_seg``, a task-sized part of it.

    Rows are range-partitioned by event and time, which splits an event wherever its rows are
    dense. The numbers are written with the rows, so a recomputed task cannot shift them.
    """
    order = [col(c) for c in (layout.key, layout.ts, "_tie")]  # the hash parts rows of one time
    ranged = samples.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the partition
    ranged = cut_lineage(
        ranged.withColumns({"_seg": F.spark_partition_id().cast("long"), "_row": row})
    )
    # One row per event and range partition.
    counts = ranged.groupBy(layout.key, "_seg").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_least")
    )
    earlier = W.partitionBy(layout.key).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_least")
    offsets = counts.select(layout.key, "_seg", offset.alias("_offset"))
    numbered = ranged.join(offsets, [layout.key, "_seg"])
    return numbered.withColumn("pos", F.col("_row") + F.col("_offset")).drop("_row", "_offset")


def overlay_scan(
    rows: DataFrame, partition: list[str], order: list[str], sensors: list[str], carried: list[str] = []
) -> DataFrame:
    """The overlay of groups that lie in one task each, by one sort.

    Rows are numbered in ``order`` unless they have a ``pos``. ``carried`` names the columns with
    the known values around a group, ``prev_pos:<s>`` and so on; these, ``_seg`` and ``_tie`` are
    not returned.
    """
    helpers = {*sensors, *carried, "pos", "_seg", "_tie"}
    kept = [c for c in rows.columns if c not in helpers]
    numbered = "pos" in rows.columns

    def overlaid(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ends = np.append(starts[1:], table.num_rows)
        first, last = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
        at = table["pos"].to_numpy() if numbered else np.arange(table.num_rows) - first
        out = table.select(kept).append_column("pos", pa.array(at.astype(np.int64)))
        for s in sensors:
            around = {c.split(":")[0]: table[c] for c in carried if c.split(":", 1)[1] == s}
            seen = known_neighbours(table[s], at, first, last, around)
            with np.errstate(all="ignore"):  # as in SQL, infinities give NaN
                share = (at - seen.prev_pos) / (seen.next_pos - seen.prev_pos)
                line = seen.prev_val + (seen.next_val - seen.prev_val) * share
            value = np.where(seen.has_next, line, seen.prev_val)
            out = out.append_column(s, pa.array(value, pa.float64(), mask=seen.known | ~seen.has_prev))
        return out

    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType(
        [fields[c] for c in kept]
        + [T.StructField("pos", T.LongType())]
        + [T.StructField(s, T.DoubleType()) for s in sensors]
    )
    placed = rows.repartition(*[col(c) for c in partition]).sortWithinPartitions(
        *[col(c) for c in [*partition, *order]]
    )
    return placed.mapInArrow(whole_groups(partition, overlaid), schema)


def interpolation_overlay(
    samples: DataFrame, index: EventIndex, limit: int = SEGMENT_ROWS, parts: int | None = None
) -> DataFrame:
    """Interpolated value (by row position) where a sensor is null, null everywhere else.

    Nothing is filled before a sensor's first known value; after its last one that value holds.
    Rows of the same time are ordered by a hash of their content, so the result is repeatable.
    Events up to ``limit`` rows are handled as a whole, longer ones in ``parts`` ranges of rows, by
    default of about ``limit`` rows each.
    """
    layout = index.layout
    sensors = list(layout.sensors)
    samples = samples.withColumns({s: col(s).cast("double") for s in sensors}).withColumn(
        "_tie", F.xxhash64(*[col(c) for c in samples.columns])
    )
    order = [layout.ts, "_tie"]

    def whole(rows: DataFrame) -> DataFrame:
        return overlay_scan(rows, [layout.key], order, sensors)

    if index.max_rows <= limit:
        return whole(samples)
    is_long = F.col("n_rows") > limit
    parts = parts or -(-index.total_rows // limit)
    rows = number_long_events(keep_events(samples, index.keep(is_long)), layout, parts)
    carry = segment_carry(rows, rows, layout.key, "pos", sensors, parts)
    entered = {
        f"{side}_{part}:{s}": col(f"{side}:{s}")[part]
        for s in sensors
        for side in ("prev", "next")
        for part in ("pos", "val")
    }
    carried = carry.select(layout.key, "_seg", *[value.alias(name) for name, value in entered.items()])
    rows = rows.join(carried, [layout.key, "_seg"], "left")
    split = overlay_scan(rows, [layout.key, "_seg"], order, sensors, list(entered))
    return whole(keep_events(samples, index.keep(~is_long))).unionByName(split)
