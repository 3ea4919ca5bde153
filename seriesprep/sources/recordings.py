"""Raw and converted recordings."""

from __future__ import annotations

import re
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesprep.functions.naming import (
    class_folder,
    decoded_path,
    directory_version,
    event_key,
    version_number,
)
from seriesprep.functions.sensors import missing_to_null
from seriesprep.operators.catalog import event_catalog
from seriesprep.schema import RAW_CSV_SCHEMA, VERSION_PREFIX, SeriesLayout, col


def list_dataset(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of every file below ``root``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length")


def in_folder_of(path: Column, root: str) -> Column:
    """Whether a file lies in ``<root>/<folder>/``: copies in deeper folders are no recordings."""
    base = re.escape(urlparse(root).path.rstrip("/"))
    return path.rlike(f"{base}/[^/]+/[^/]+$")


def in_class_folder(path: Column) -> Column:
    return class_folder(path).isNotNull()


def event_files(spark: SparkSession, suffix: str, schema: T.StructType) -> DataFrameReader:
    """Reader for the files of one kind anywhere below a folder; the schema is never inferred."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{suffix}")
        .schema(schema)
    )


def parquet_row_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows per Parquet file below ``root``, read from no data column."""
    rows = event_files(spark, "parquet", T.StructType([T.StructField("timestamp", T.StringType())]))
    path = decoded_path(F.col("_metadata.file_path"))
    return (
        rows.parquet(root)
        .filter(in_folder_of(path, root))
        .groupBy(path.alias("path"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def dataset_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Catalog of a dataset that keeps one file per event in numeric class folders."""
    listing = list_dataset(spark, root).filter(in_folder_of(F.col("path"), root))
    return event_catalog(listing, parquet_row_counts(spark, root))


def as_samples(files: DataFrame, layout: SeriesLayout, root: str) -> DataFrame:
    """Rows of event files as one long samples table keyed by class folder and file name.

    Time is parsed and NaN turned to null here, once for all later jobs.
    """
    path = decoded_path(F.col("_metadata.file_path"))
    rows = files.select("*", path.alias("_path")).filter(
        in_class_folder(F.col("_path")) & in_folder_of(F.col("_path"), root)
    )
    if "timestamp" in files.columns:
        rows = rows.withColumn(layout.ts, F.col("timestamp").try_cast("timestamp_ntz")).drop("timestamp")
    keys = {layout.key: event_key(F.col("_path")), layout.code: class_folder(F.col("_path"))}
    return missing_to_null(rows.withColumns(keys).drop("_path"), layout)


def read_csv_recordings(
    spark: SparkSession,
    root: str,
    schema: T.StructType = RAW_CSV_SCHEMA,
    layout: SeriesLayout = SeriesLayout(),
) -> DataFrame:
    """All ``.csv`` recordings in numeric class folders; header names are checked."""
    reader = event_files(spark, "csv", schema).option("header", True).option("enforceSchema", False)
    return as_samples(reader.csv(root), layout, root)


def read_parquet_recordings(
    spark: SparkSession,
    root: str,
    schema: T.StructType = RAW_CSV_SCHEMA,
    layout: SeriesLayout = SeriesLayout(),
) -> DataFrame:
    """All per-event ``.parquet`` recordings in numeric class folders, time still being text."""
    return as_samples(event_files(spark, "parquet", schema).parquet(root), layout, root)


def convert_csv_dataset(
    spark: SparkSession,
    root: str,
    output: str,
    schema: T.StructType = RAW_CSV_SCHEMA,
    layout: SeriesLayout = SeriesLayout(),
) -> None:
    """Rewrite the CSV recordings as Parquet, one folder per class; a narrow job.

    Small files share a task, and rows of one event stay together in it, so event ids compress
    well and partial aggregates per event stay small in every later scan.
    """
    samples = read_csv_recordings(spark, root, schema, layout)
    samples.write.mode("overwrite").partitionBy(layout.code).parquet(output)


def samples_schema(layout: SeriesLayout = SeriesLayout()) -> T.StructType:
    return T.StructType(
        [T.StructField(layout.key, T.StringType()), T.StructField(layout.ts, T.TimestampNTZType())]
        + [T.StructField(s, T.DoubleType()) for s in layout.sensors]
        + [
            T.StructField(layout.label, T.DoubleType()),
            T.StructField(layout.code, T.IntegerType()),
        ]
    )


def read_samples(
    spark: SparkSession, path: str, layout: SeriesLayout = SeriesLayout()
) -> DataFrame:
    """Converted recordings with a declared schema; filters on class prune whole folders."""
    return spark.read.schema(samples_schema(layout)).parquet(path)


def read_event(samples: DataFrame, event_id, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """One event in time order."""
    return samples.filter(F.col(layout.key) == F.lit(event_id)).orderBy(layout.ts)


def head_of_events(samples: DataFrame, layout: SeriesLayout, n: int) -> DataFrame:
    """First ``n`` samples of each event in time order (G5), of equal times by content hash.

    The rank filter is applied per task before the shuffle, so a long event sends ``n`` rows.
    """
    tie = F.xxhash64(*[col(c) for c in samples.columns])
    window = W.partitionBy(layout.key).orderBy(col(layout.ts), tie)
    ranked = samples.withColumn("_n", F.row_number().over(window))
    return ranked.filter(F.col("_n") <= n).drop("_n")


def has_converted_data(listing: DataFrame) -> bool:
    """Whether any Parquet file sits in a numeric class folder."""
    path = F.col("path")
    return not listing.filter(path.endswith(".parquet") & in_class_folder(path)).isEmpty()


def dataset_size(listing: DataFrame) -> DataFrame:
    return listing.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def dataset_versions(listing: DataFrame) -> DataFrame:
    """One row per converted-dataset folder in the listing, with its version as a number."""
    folder = F.regexp_extract("path", f"(.*/{VERSION_PREFIX}[^/]*)/", 1)
    path = F.col("path")
    is_data = path.endswith(".parquet") & in_class_folder(path)
    version = directory_version(F.regexp_extract("directory", "([^/]+)$", 1))
    return (
        listing.withColumns({"directory": folder, "_data": is_data})
        .groupBy("directory")
        .agg(F.bool_or("_data").alias("has_data"), F.sum("length").alias("total_bytes"))
        .withColumns({"version": version, "version_number": version_number(version)})
        .filter(F.col("version").isNotNull())
    )


def latest_version(versions: DataFrame) -> DataFrame:
    """The folder with the greatest version, compared by number and not by text."""
    newest = F.max_by(F.struct("directory", "version", "version_number", "has_data"), "version_number")
    return versions.agg(newest.alias("v")).select("v.*")


def is_valid_conversion(
    version: Column, has_data: Column, online_version: str | None, latest_required: bool
) -> Column:
    """Whether a local folder may be used instead of acquiring the dataset again."""
    if online_version is None:
        return F.lit(False)
    current = version == online_version if latest_required else F.lit(True)
    return F.coalesce(version.isNotNull() & has_data & current, F.lit(False))
