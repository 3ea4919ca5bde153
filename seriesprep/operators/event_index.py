"""One row per event, built in one pass over the samples.

Anchors, validity and the moments behind the standardization metrics all come from a single
map-side-combined ``groupBy(event)``: a hot event reaches the shuffle as one partial row per
map task. The table is written once, so its size is known before anyone broadcasts it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesprep.functions.sensors import valid_sample
from seriesprep.schema import SeriesLayout, col
from seriesprep.session import cut_lineage

# A broadcast of event columns is allowed only below both bounds.
BROADCAST_EVENTS = 1_000_000
BROADCAST_BYTES = 256 * 1024 * 1024
# Beyond them, events with more than 1 / HEAVY_EVENTS of all rows still go by broadcast: there
# can be no more than HEAVY_EVENTS of them. The others are safe to shuffle on the event key.
HEAVY_EVENTS = 100_000
BYTES_PER_COLUMN = 24
MIN_STEPS_PER_TASK = 4_000
MAX_STEPS_PER_TASK = 500_000


@dataclass(frozen=True)
class EventIndex:
    """Per-event table with the upper bounds that physical choices rest on."""

    table: DataFrame
    heavy_keys: DataFrame  # events with more than 1 / HEAVY_EVENTS of all rows
    layout: SeriesLayout
    n_events: int
    key_bytes: int
    total_rows: int
    max_rows: int
    max_span_us: int
    total_span_us: float

    @property
    def split(self) -> list[str]:
        """``["split"]`` when the events carry the split they belong to."""
        return [c for c in self.table.columns if c == "split"]

    @property
    def code(self) -> list[str]:
        return [c for c in self.table.columns if c == self.layout.code]

    def fits_broadcast(self, n_columns: int) -> bool:
        size = self.key_bytes + self.n_events * BYTES_PER_COLUMN * (n_columns + 1)
        return self.n_events <= BROADCAST_EVENTS and size <= BROADCAST_BYTES

    def max_steps(self, seconds: int) -> int:
        return self.max_span_us // (seconds * 1_000_000) + 1

    def step_partitions(self, seconds: int) -> int:
        """Tasks for per-step work: first up to the configured parallelism, then by size.

        Filling gaps and stacking windows multiply what was shuffled, so the shuffled bytes that
        adaptive execution goes by say too little; the index knows the number of steps.
        """
        steps = int(self.total_span_us // (seconds * 1_000_000)) + self.n_events
        parallelism = int(self.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by_parallelism = min(parallelism, -(-steps // MIN_STEPS_PER_TASK))
        return max(1, by_parallelism, -(-steps // MAX_STEPS_PER_TASK))

    def keep(self, condition: Column) -> "EventIndex":
        """Subset of the events; the bounds stay valid as upper bounds.

        The heavy keys stay complete, so that samples of a dropped heavy event are set aside
        before anything is shuffled.
        """
        return replace(self, table=self.table.filter(condition))


def micros(frame: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column of ``frame``.

    Wall-clock times (``timestamp_ntz``) are counted as they read, so no session zone and no
    daylight saving moves them; ``timestamp`` columns are instants.
    """
    ts = col(name)
    if not isinstance(frame.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(ts.cast("timestamp"))
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def time_at(us: Column, kind: T.DataType) -> Column:
    """The time of type ``kind`` at ``us`` microseconds, as counted by :func:`micros`."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.timestamp_micros(us).cast(kind)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", us, epoch)


def moment_columns(layout: SeriesLayout) -> list[Column]:
    """Count, mean and sum of squared deviations of each sensor, per event."""
    columns = []
    for sensor in layout.sensors:
        x = col(sensor)
        columns += [
            F.count(x).alias(f"n:{sensor}"),
            F.avg(x).alias(f"mean:{sensor}"),
            (F.var_pop(x) * F.count(x)).alias(f"m2:{sensor}"),
        ]
    return columns


def minimum_columns(layout: SeriesLayout) -> list[Column]:
    return [F.min(col(s)).alias(f"min:{s}") for s in layout.sensors]


def index_events(
    samples: DataFrame,
    layout: SeriesLayout,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    extra: list[Column] | None = None,
) -> EventIndex:
    """Scan the samples once and write the per-event table.

    ``ranges`` adds the column ``valid``; ``extra`` adds further aggregates.
    """
    us = micros(samples, layout.ts)
    columns = [
        F.min(us).alias("t0"),
        F.max(us).alias("t1"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    if layout.code in samples.columns:
        columns.append(F.min(col(layout.code)).alias(layout.code))
    if ranges is not None:
        columns.append(F.bool_and(valid_sample(layout, ranges)).alias("valid"))
    return measured(samples.groupBy(layout.key).agg(*columns, *(extra or [])), layout)


def index_catalog(catalog: DataFrame, layout: SeriesLayout) -> EventIndex:
    """Index from a catalog whose ``num_timesteps`` is known, without touching the samples."""
    unknown = F.lit(None).cast("long")
    rows = F.coalesce("num_timesteps", F.lit(0))
    return measured(catalog.withColumns({"t0": unknown, "t1": unknown, "n_rows": rows}), layout)


def measured(events: DataFrame, layout: SeriesLayout) -> EventIndex:
    """Write a per-event table and read off its bounds."""
    table = cut_lineage(events)
    bounds = table.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.coalesce(F.sum(F.octet_length(col(layout.key).cast("string"))), F.lit(0)).alias("key_bytes"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("max_rows"),
        F.coalesce(F.max(F.col("t1") - F.col("t0")), F.lit(0)).alias("max_span_us"),
        F.coalesce(F.sum((F.col("t1") - F.col("t0")).cast("double")), F.lit(0.0)).alias("total_span_us"),
    ).first()
    heavy_keys = table.filter(F.col("n_rows") > bounds["total_rows"] // HEAVY_EVENTS)
    return EventIndex(table, heavy_keys.select(layout.key), layout, **bounds.asDict())


def attach_events(
    samples: DataFrame, index: EventIndex, *columns: str, broadcast: bool | None = None
) -> DataFrame:
    """Add per-event columns to every sample; samples of events not in the index drop out.

    While the index fits a broadcast (or as ``broadcast`` says) the samples do not move.
    Otherwise only the samples of light events are shuffled.
    """
    key = index.layout.key
    side = index.table.select(key, *[col(c) for c in columns])
    if index.fits_broadcast(len(columns)) if broadcast is None else broadcast:
        return samples.join(F.broadcast(side), key)
    heavy_keys = F.broadcast(index.heavy_keys)
    heavy = side.join(heavy_keys, key, "left_semi")
    light = side.join(heavy_keys, key, "left_anti")
    light_samples = samples.join(heavy_keys, key, "left_anti")
    return samples.join(F.broadcast(heavy), key).unionByName(light_samples.join(light, key))


def keep_events(samples: DataFrame, index: EventIndex) -> DataFrame:
    """Samples of the events in the index (semi join on a unique key)."""
    return attach_events(samples, index)
