"""Stored results: catalog cache, metrics, splits and tensors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesprep.functions.labels import fold_transient, one_hot
from seriesprep.operators.event_index import attach_events, index_catalog
from seriesprep.operators.segments import with_halo
from seriesprep.schema import SPLIT_SEED, SeriesLayout, col
from seriesprep.sources.versions import current_version, read_version, write_version

BLOCK_BINS = 1_024
EPOCH_BUFFER = 16_384
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in NOTHING_STORED:
            return None
        raise


def cached_table(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], use_cached: bool = True
) -> DataFrame:
    """Stored table at ``path``, built first when absent or when ``use_cached`` is off.

    A table that is built again replaces the old one at once, see :mod:`seriesprep.sources.versions`.
    """
    stored = read_version(spark, path) if use_cached else None
    return spark.read.parquet(write_version(build(), path)) if stored is None else stored


def metrics_path(root: str, name: str) -> str:
    """Folder of a metric table; the name is escaped, so any text is a name of its own."""
    return f"{root}/metrics-{quote(name, safe='').replace('%', '~')}"


def save_metrics(
    spark: SparkSession,
    root: str,
    name: str,
    build: Callable[[], DataFrame],
    use_cached: bool = True,
) -> DataFrame:
    """Metric table kept under its name; computed once."""
    cached_table(spark, metrics_path(root, name), build, use_cached)
    return load_metrics(spark, root, name)


def load_metrics(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Stored metric table; reads only the folder of that name."""
    return spark.read.parquet(current_version(spark, metrics_path(root, name)) or metrics_path(root, name))


def write_split(samples: DataFrame, divided: DataFrame, layout: SeriesLayout, path: str) -> None:
    """Samples of each split in their own folders, replacing an earlier draw as a whole."""
    index = index_catalog(divided, layout)
    attach_events(samples, index, "split").write.mode("overwrite").partitionBy(
        "split", layout.code
    ).parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)


def write_windows(windows: DataFrame, layout: SeriesLayout, path: str) -> None:
    folders = [c for c in ("split", layout.code) if c in windows.columns]
    windows.write.mode("overwrite").partitionBy(*folders).parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_window_blocks(
    dense: DataFrame, layout: SeriesLayout, path: str, n: int, block: int = BLOCK_BINS
) -> None:
    """Store the windows of ``dense`` (all bins of every event) without their copies.

    A row holds up to ``block`` bins of an event and the ``n - 1`` before them, so each bin is stored
    about once, not once per window. Windows are made when the blocks are read.
    """
    block = max(block, n)
    constants = [c for c in ("split", layout.code) if c in dense.columns]
    step = F.array(*[col(s) for s in layout.sensors]).alias("step")
    cell = F.struct("bin", step, fold_transient(col(layout.label)).alias("label"))
    cut = with_halo(dense, "bin", block, n - 1)
    blocks = cut.groupBy(layout.key, "_seg", *[col(c) for c in constants]).agg(
        F.array_sort(F.collect_list(cell)).alias("_cells")
    )
    # A last block of nothing but its halo has no window.
    blocks = blocks.filter(F.col("_cells")[F.size("_cells") - 1]["bin"] >= F.col("_seg") * block)
    blocks.select(
        layout.key,
        F.col("_seg").alias("block"),
        *[col(c) for c in constants],
        F.lit(n).alias("n"),
        F.col("_cells.bin")[0].alias("first_bin"),
        F.col("_cells.step").alias("steps"),
        F.col("_cells.label").alias("labels"),
    ).write.mode("overwrite").partitionBy(*constants).parquet(path)


def windows_in(blocks: DataFrame, layout: SeriesLayout, n: int) -> DataFrame:
    """The windows of ``n`` bins of stored blocks, as :func:`read_windows` returns them."""
    constants = [c for c in (layout.code, "split") if c in blocks.columns]
    # Behind the first block, windows end in the block's own bins only.
    last = F.when(F.col("block") == 0, F.lit(n - 1)).otherwise(F.col("n") - 1)
    ends = F.when(F.size("steps") > last, F.sequence(last, F.size("steps") - 1))

    def window(end: Column) -> Column:
        label = F.get("labels", end)
        return F.struct(
            (F.col("first_bin") + end - (n - 1)).alias("window_idx"),
            F.slice("steps", end - (n - 2), F.lit(n)).alias("X"),
            one_hot(label).alias("y"),
            label.alias("label"),
        )

    fits = F.when(F.col("n") >= n, F.transform(ends, window)).otherwise(
        F.raise_error(F.lit(f"the blocks are stored for windows of fewer than {n} bins"))
    )
    return blocks.select(layout.key, *[col(c) for c in constants], F.inline(fits))


def read_window_blocks(spark: SparkSession, path: str, layout: SeriesLayout, n: int) -> DataFrame:
    """Windows of ``n`` bins, at most those the blocks were written for."""
    return windows_in(spark.read.parquet(path), layout, n)


def epoch_batches(
    blocks: DataFrame,
    layout: SeriesLayout,
    n: int,
    epoch: int,
    batch: int = 256,
    buffer: int = EPOCH_BUFFER,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Every window once, in an order of its own for each ``epoch``, as batches for training.

    Blocks, not windows, are dealt anew, by a hash of epoch and block; inside a task the windows of
    about ``buffer`` of them are mixed before they leave, so memory is bounded by the buffer. A
    row is a batch: ``n_rows`` and, as bytes, ``X`` (float32, rows by steps by sensors) and
    ``labels`` (int64); :func:`local_batches` reads them one by one. Without null: an unknown value
    counts as the mean, 0.
    """
    spark = blocks.sparkSession
    order = F.xxhash64(F.lit(seed), F.lit(epoch), col(layout.key), F.col("block"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.withColumn("_order", order).repartitionByRange(parts, "_order").sortWithinPartitions("_order")
    sensors = len(layout.sensors)

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        x, labels = np.zeros((0, n, sensors), np.float32), np.zeros(0, np.int64)

        def told(end: int) -> Iterator[pa.RecordBatch]:
            for at in range(0, end, batch):
                some = slice(at, min(at + batch, end))
                columns = [
                    pa.array([some.stop - at], pa.int32()), pa.array([x[some].tobytes()], pa.binary()),
                    pa.array([labels[some].tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["n_rows", "X", "labels"])

        for rows in batches:
            values = rows.column("X").flatten().flatten().to_numpy(zero_copy_only=False)
            new = np.nan_to_num(np.asarray(values, np.float32)).reshape(rows.num_rows, n, sensors)
            x = np.concatenate([x, new])
            labels = np.concatenate([labels, rows.column("label").to_numpy(zero_copy_only=False).astype(np.int64)])
            order = rng.permutation(len(x))
            x, labels = x[order], labels[order]
            if len(x) > buffer:
                leave = (len(x) - buffer // 2) // batch * batch
                yield from told(leave)
                x, labels = x[leave:], labels[leave:]
        yield from told(len(x))

    windows = windows_in(dealt, layout, n).select("X", "label")
    return windows.mapInArrow(mixed, "n_rows int, X binary, labels binary")


def local_batches(batches: DataFrame, n: int, sensors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batches one by one on the driver, as arrays; one partition is held at a time."""
    for row in batches.toLocalIterator():
        x = np.frombuffer(row["X"], np.float32).reshape(row["n_rows"], n, sensors)
        yield x, np.frombuffer(row["labels"], np.int64)


def map_events(
    samples: DataFrame,
    layout: SeriesLayout,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    columns: Sequence[str] = (),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Run a function of the user's own on every event.

    It gets the event's rows (key, time, then ``columns``) as an iterator of Arrow batches in time
    order, ``tie`` columns deciding between equal times, and yields batches of ``schema``. Batches
    are read as the function asks for them, so an event may be longer than what a task can hold.
    """
    named = list(dict.fromkeys([layout.key, layout.ts, *columns, *tie]))
    narrow = samples.select(*[col(c) for c in named])
    # Grouping needs rows by key; the finer order serves it, so none is sorted again.
    ordered = narrow.repartition(layout.key).sortWithinPartitions(layout.key, layout.ts, *tie)

    def streamed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the types ask for iterators
        yield from function(rows)

    return ordered.groupBy(layout.key).applyInArrow(streamed, schema)


def map_event_batches(
    windows: DataFrame,
    layout: SeriesLayout,
    function: Callable,
    schema: str,
    max_windows: int,
    columns: Sequence[str] = ("X", "y", "label"),
    merge: Sequence[Column] = (),
) -> DataFrame:
    """Run a pandas function on batches of one event's windows.

    An event is cut into batches of ``max_windows`` windows, so memory per call is bounded
    whatever its length. The function gets the event's key, the number of the ``batch``, the
    ``window_idx`` and the ``columns`` asked for, and returns rows of ``schema``. With ``merge``,
    aggregates over those rows by event, the batches of an event become one row.
    """
    batch = F.floor(F.col("window_idx") / max_windows).alias("batch")
    narrow = windows.select(layout.key, batch, "window_idx", *[col(c) for c in columns])
    partial = narrow.groupBy(layout.key, "batch").applyInPandas(function, schema)
    return partial.groupBy(layout.key).agg(*merge) if merge else partial
