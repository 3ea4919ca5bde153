"""Event catalog: building, filtering, counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesprep.functions import naming
from seriesprep.schema import (
    CATALOG_COLUMNS,
    CLASS_NAMES,
    SOURCE_NAMES,
    class_dimension,
    class_label,
    class_name,
    source_label,
)


def describe_files(files: DataFrame) -> DataFrame:
    """Everything a path tells about an event, for ``files(path, ...)``.

    Files outside numeric class folders and files that hold neither samples (``.parquet``) nor
    tensors (``.npz``) are no events.
    """
    path = F.col("path")
    stem = naming.file_stem(path)
    code = naming.class_folder(path)
    return files.filter(code.isNotNull() & path.rlike(r"\.(parquet|npz)$")).withColumns(
        {
            "event_id": naming.event_key(path),
            "hash_id": naming.hash_id(path),
            "class_code": code,
            "class_type": class_name(code),
            "source": naming.source_of(stem),
            "well_id": naming.well_id_of(stem),
            "timestamp": naming.recorded_at(stem),
        }
    )


def event_catalog(listing: DataFrame, row_counts: DataFrame) -> DataFrame:
    """One row per event file.

    ``listing(path, length)`` drives it, so a file without rows is kept with 0 timesteps; files
    without countable rows (tensors) have a null count. Both sides hold one row per file of one
    dataset and meet on the whole path.
    """
    key = naming.plain_path(F.col("path")).alias("_key")
    counts = row_counts.select(key, F.col("n_rows").alias("_n"))
    described = describe_files(listing).select("*", key).join(counts, "_key", "left")
    counted = F.when(F.col("path").endswith(".parquet"), F.coalesce("_n", F.lit(0)))
    return described.select(
        "event_id",
        *CATALOG_COLUMNS[:-2],
        F.col("length").alias("file_size"),
        counted.cast("long").alias("num_timesteps"),
    )


def filter_catalog(
    catalog: DataFrame,
    class_types: Sequence[int | str] | None = None,
    sources: Sequence[int | str] | None = None,
    well_ids: Sequence[int] | None = None,
    empty_means_all: bool = False,
) -> DataFrame:
    """Rows matching every given list; ``None`` does not filter.

    An empty list keeps nothing, or everything with ``empty_means_all`` (as the split does).
    """
    wanted = {
        "class_type": None if class_types is None else [class_label(c) for c in class_types],
        "source": None if sources is None else [source_label(s) for s in sources],
        "well_id": None if well_ids is None else list(well_ids),
    }
    for name, values in wanted.items():
        if values is None or (empty_means_all and not values):
            continue
        catalog = catalog.filter(F.col(name).isin(values) if values else F.lit(False))
    return catalog


def class_source_counts(catalog: DataFrame) -> DataFrame:
    """Events per class and source, empty classes included, with a ``Total`` row.

    ``total`` also counts events without a known source.
    """
    per_class = catalog.groupBy("class_type").agg(
        *[F.count_if(F.col("source") == name).alias(name) for name in SOURCE_NAMES],
        F.count(F.lit(1)).alias("total"),
    )
    counts = [*SOURCE_NAMES, "total"]
    dense = class_dimension(catalog.sparkSession).join(per_class, "class_type", "left")
    table = dense.rollup("class_code").agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counts]
    )
    name = F.coalesce(class_name(F.col("class_code")), F.lit("Total"))
    position = F.coalesce("class_code", F.lit(len(CLASS_NAMES)))
    return table.orderBy(position).select(name.alias("class_type"), *counts)


def class_counts(catalog: DataFrame) -> DataFrame:
    return (
        catalog.groupBy("class_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .orderBy(F.desc("n_events"), "class_type")
    )
