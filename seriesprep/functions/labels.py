"""Label folding, one-hot coding and arg-max."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesprep.schema import NUM_CLASSES, TRANSIENT_OFFSET


def fold_transient(label: Column) -> Column:
    """Integer label with transient phases mapped onto their anomaly class."""
    y = label.cast("int")
    return F.when(y >= TRANSIENT_OFFSET, y - TRANSIENT_OFFSET).otherwise(y)


def one_hot(label: Column, num_classes: int = NUM_CLASSES) -> Column:
    """0/1 vector of length ``num_classes``; a label outside it is an error."""
    vector = F.array(*[(label == c).cast("int") for c in range(num_classes)])
    bad = F.raise_error(F.concat(F.lit("label out of range: "), label.cast("string")))
    return F.when(label.between(0, num_classes - 1), vector).when(label.isNotNull(), bad)


def arg_max(scores: Column) -> Column:
    """0-based index of the largest score, first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(powers, lambda p: p / total)
