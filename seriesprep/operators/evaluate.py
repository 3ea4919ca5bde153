"""Scoring quality and alignment of predictions to the raw timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesprep.functions.labels import arg_max
from seriesprep.operators.event_index import EventIndex
from seriesprep.operators.resample import assign_bins
from seriesprep.schema import NUM_CLASSES, col
from seriesprep.session import cut_lineage

PROBABILITY_FLOOR = 1e-7
# Bins whose predictions stand in one array, and what may be broadcast of such arrays.
RANGE_BINS = 256
PACKED_ROWS = 1_000_000
PACKED_BYTES = 256 * 1024 * 1024
CELL_BYTES = 32


def predicted_class(scores: DataFrame, column: str = "probability") -> DataFrame:
    return scores.withColumn("predicted", arg_max(F.col(column)))


def match_labels(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Pair predictions with labels by window, not by position."""
    return predictions.join(labels.select(key, "window_idx", "label"), [key, "window_idx"])


def checked_class(name: str, num_classes: int) -> Column:
    """A class column; a null or a value that is no class fails the job."""
    value = F.col(name)
    known = F.coalesce(value.between(0, num_classes - 1), F.lit(False))
    told = F.concat(F.lit(f"no class in {name}: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(known, value).otherwise(F.raise_error(told))


def checked_scores(scored: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    return scored.withColumns({c: checked_class(c, num_classes) for c in ("label", "predicted")})


def confusion_matrix(scored: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """Counts by real label (rows) and predicted class (columns ``p0`` ...), zeros included."""
    cells = checked_scores(scored, num_classes).groupBy("label").agg(
        *[F.count_if(F.col("predicted") == p).alias(f"p{p}") for p in range(num_classes)]
    )
    every = scored.sparkSession.range(0, num_classes, 1, 1)
    labels = every.select(F.col("id").cast("int").alias("label"))
    return (
        labels.join(cells, "label", "left")
        .fillna(0, [f"p{p}" for p in range(num_classes)])
        .orderBy("label")
    )


def accuracy_and_loss(scored: DataFrame, column: str = "probability") -> DataFrame:
    """Share of right predictions and mean categorical cross-entropy."""
    own = F.get(F.col(column), F.col("label"))
    return checked_scores(scored).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"),
        F.avg(-F.ln(F.greatest(own, F.lit(PROBABILITY_FLOOR)))).alias("loss"),
    )


def packed_predictions(spoken: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``spoken`` (one row per ``key, bin``) as one row per event and range of ``RANGE_BINS`` bins:
    ``_range``, ``_first`` and an array with the predictions of the bins from ``_first`` on.

    A bin without prediction inside a range is a null in the array.
    """
    cell = F.struct("bin", F.struct(*[col(c) for c in columns]).alias("said"))
    ranges = spoken.groupBy(key, F.floor(F.col("bin") / RANGE_BINS).alias("_range")).agg(
        F.array_sort(F.collect_list(cell)).alias("_cells"), F.min("bin").alias("_first"), F.max("bin").alias("_last")
    )
    is_dense = F.size("_cells") == F.col("_last") - F.col("_first") + 1
    at = lambda b: F.get(F.filter("_cells", lambda c: c["bin"] == b), F.lit(0))["said"]
    spread = F.transform(F.sequence("_first", "_last"), at)
    said = F.when(is_dense, F.transform("_cells", lambda c: c["said"])).otherwise(spread)
    return ranges.select(key, "_range", "_first", said.alias("_said"))


def align_predictions(
    samples: DataFrame,
    index: EventIndex,
    predictions: DataFrame,
    seconds: int,
    n: int,
    columns: list[str],
    most_rows: int = PACKED_ROWS,
) -> DataFrame:
    """Give each raw sample the prediction of the window that ends in its bin.

    Samples before the first full window get null. ``predictions`` has one row per window. They are
    packed into arrays and written, so their size is known: up to ``most_rows`` ranges of bins and
    ``PACKED_BYTES`` they are broadcast, samples stay where they are and take their element by
    position. Beyond that samples are joined on event and bin, a long event spread over its
    bins; a bin that is too dense is then left to the adaptive skew join.
    """
    layout = index.layout
    spoken = predictions.select(
        layout.key, (F.col("window_idx") + (n - 1)).alias("bin"), *[col(c) for c in columns]
    )
    timeline = assign_bins(samples, index, seconds).select(layout.key, layout.ts, "bin")
    packed = cut_lineage(packed_predictions(spoken, layout.key, columns))
    size = packed.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.size("_said") * CELL_BYTES * len(columns) + F.octet_length(col(layout.key).cast("string"))), F.lit(0)).alias("bytes"),
    ).first()
    if size["n"] > most_rows or size["bytes"] > PACKED_BYTES:
        return timeline.join(spoken, [layout.key, "bin"], "left")
    ranged = timeline.withColumn("_range", F.floor(F.col("bin") / RANGE_BINS))
    found = ranged.join(F.broadcast(packed), [layout.key, "_range"], "left")
    place = (F.col("bin") - F.col("_first")).cast("int")
    element = F.when(place >= 0, F.get("_said", place))
    return found.select(layout.key, "bin", layout.ts, *[element[c].alias(c) for c in columns])
