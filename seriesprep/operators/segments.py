"""Order-dependent work on events of any length.

A window partitioned by event puts a whole event into one task. Once the longest event (known
from the event index) exceeds ``SEGMENT_STEPS`` positions, events are cut into segments of that
many positions, each segment is handled in its own task, and what a segment needs from its
neighbours comes from two sources:

* a halo: the last ``halo`` positions of a segment are repeated at the start of the next one;
* a carry: the last known value before, and the first known value after the segment, found by
  a scan over one summary row per segment. The scan itself goes block by block, so none of its
  windows sees more than ``SCAN_BLOCK`` rows of an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesprep.operators.event_index import EventIndex
from seriesprep.schema import col

SEGMENT_STEPS = 32_768
SCAN_BLOCK = 32_768


def segment_size(n: int, size: int = SEGMENT_STEPS) -> int:
    """Positions per segment for windows of ``n``: a segment is never shorter than its halo."""
    return max(size, n)


def exclusive_scan(
    units: DataFrame,
    keys: list[str],
    unit: str,
    columns: list[str],
    max_units: int,
    descending: bool = False,
    block: int = SCAN_BLOCK,
) -> DataFrame:
    """For each unit, the nearest non-null value of each column in an earlier (later) unit."""
    order = F.desc(unit) if descending else F.asc(unit)
    before = (W.unboundedPreceding, -1)

    def nearest(window):
        return [F.last(col(c), ignorenulls=True).over(window).alias(c) for c in columns]

    if max_units <= block:
        window = W.partitionBy(*keys).orderBy(order).rowsBetween(*before)
        return units.select(*keys, unit, *nearest(window))

    outer_unit = f"{unit}^"
    blocked = units.withColumn(outer_unit, F.floor(F.col(unit) / block))
    window = W.partitionBy(*keys, outer_unit).orderBy(order).rowsBetween(*before)
    inner = blocked.select(*keys, unit, outer_unit, *nearest(window))
    pick = F.min_by if descending else F.max_by
    summaries = blocked.groupBy(*keys, outer_unit).agg(
        *[pick(col(c), F.when(col(c).isNotNull(), F.col(unit))).alias(c) for c in columns]
    )
    outer = exclusive_scan(
        summaries, keys, outer_unit, columns, -(-max_units // block), descending, block
    ).select(*keys, outer_unit, *[col(c).alias(f"outer:{c}") for c in columns])
    return inner.join(outer, [*keys, outer_unit], "left").select(
        *keys, unit, *[F.coalesce(col(c), col(f"outer:{c}")).alias(c) for c in columns]
    )


def summarize_units(
    rows: DataFrame, keys: list[str], unit: str, pos: str, columns: list[str], first: bool
) -> DataFrame:
    """Per unit, the first or last known value of each column as ``struct(pos, value)``."""
    pick, edge = (F.min_by, F.min) if first else (F.max_by, F.max)
    aggregates = []
    for c in columns:
        known = F.when(col(c).isNotNull(), F.col(pos))
        aggregates += [edge(known).alias(f"pos:{c}"), pick(col(c), known).alias(f"val:{c}")]
    summary = rows.groupBy(*keys, unit).agg(*aggregates)
    states = [
        F.when(
            col(f"pos:{c}").isNotNull(),
            F.struct(col(f"pos:{c}").alias("pos"), col(f"val:{c}").alias("val")),
        ).alias(c)
        for c in columns
    ]
    return summary.select(*keys, unit, *states)


def segment_carry(
    cut_before: DataFrame,
    cut_after: DataFrame,
    key: str,
    pos: str,
    columns: list[str],
    max_units: int,
    block: int = SCAN_BLOCK,
) -> DataFrame:
    """``prev:<c>`` and ``next:<c>`` states that enter each segment ``_seg`` of each event.

    Both inputs are the same rows. ``cut_before`` numbers the segments by where a group starts
    (its halo included), ``cut_after`` by where its own positions start.
    """
    last_known = summarize_units(cut_before, [key], "_seg", pos, columns, first=False)
    first_known = summarize_units(cut_after, [key], "_seg", pos, columns, first=True)
    prev = exclusive_scan(last_known, [key], "_seg", columns, max_units, False, block)
    following = exclusive_scan(first_known, [key], "_seg", columns, max_units, True, block)
    renamed = [
        frame.select(key, "_seg", *[col(c).alias(f"{side}:{c}") for c in columns])
        for side, frame in (("prev", prev), ("next", following))
    ]
    return renamed[0].join(renamed[1], [key, "_seg"], "full")


def neighbours(
    rows: DataFrame,
    partition: list[str],
    pos: str,
    columns: list[str],
    carry: DataFrame | None,
) -> DataFrame:
    """Add the known value at or before each row and the one after it.

    Per column: ``prev_pos:<c>``, ``prev_val:<c>``, ``next_pos:<c>``, ``next_val:<c>``.

    Both directions run over growing frames; a frame that shrinks towards the end would be
    recomputed for every row.
    """
    by_partition = W.partitionBy(*partition)
    behind = by_partition.orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    ahead = by_partition.orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, -1)

    def nearest(side, window):
        states = {}
        for c in columns:
            known = F.when(col(c).isNotNull(), F.col(pos).cast("long"))
            states[f"{side}_pos:{c}"] = F.last(known, ignorenulls=True).over(window)
            states[f"{side}_val:{c}"] = F.last(col(c), ignorenulls=True).over(window)
        return states

    seen = rows.withColumns(nearest("prev", behind)).withColumns(nearest("next", ahead))
    if carry is None:
        return seen
    seen = seen.join(carry, partition, "left")
    entered = {
        f"{side}_{part}:{c}": F.coalesce(col(f"{side}_{part}:{c}"), col(f"{side}:{c}")[part])
        for side in ("prev", "next")
        for part in ("pos", "val")
        for c in columns
    }
    kept = [col(c) for c in rows.columns]
    return seen.select(*kept, *[value.alias(name) for name, value in entered.items()])


def with_halo(rows: DataFrame, pos: str, size: int, halo: int) -> DataFrame:
    """Segment number of each row; rows in the last ``halo`` positions also join the next one."""
    own = F.floor(F.col(pos) / size)
    if halo == 0:
        return rows.withColumn("_seg", own)
    in_tail = F.pmod(F.col(pos), F.lit(size)) >= size - halo
    return rows.withColumn(
        "_seg", F.explode(F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own)))
    )


def segment_markers(index: EventIndex, seconds: int, size: int, halo: int) -> DataFrame:
    """Positions that must exist so that gaps can be filled inside each segment alone.

    First and last position of every segment, and the position where the next one's halo starts.
    """
    steps = F.expr(f"(t1 - t0) div {seconds * 1_000_000}L + 1")
    constants = [index.layout.key, "t0", "t1", *index.code, *index.split]
    long_events = index.table.select(
        *constants, steps.alias("_steps")
    ).filter(F.col("_steps") > size)
    segments = long_events.withColumn(
        "_seg", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_steps") - 1) / size)))
    )
    start = F.col("_seg") * size
    end = F.least(start + size, F.col("_steps")) - 1
    wanted = [start, end] + ([start + size - halo] if halo else [])
    return (
        segments.withColumn("bin", F.explode(F.array_distinct(F.array(*wanted))))
        .filter(F.col("bin") < F.col("_steps"))
        .select(*constants, "bin")
    )
