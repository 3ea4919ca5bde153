"""Tables that are replaced as a whole, and a CSV conversion that does only what is new.

A table is a folder of versions, ``v-1``, ``v-2``, ...; the greatest with Spark's ``_SUCCESS`` marker
counts. The marker is written last, so a reader or a job that was killed never sees half a
table, and a reader of the version before goes on undisturbed.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesprep.functions.naming import decoded_path, event_key
from seriesprep.schema import RAW_CSV_SCHEMA, SeriesLayout, col
from seriesprep.sources.recordings import as_samples, in_class_folder, in_folder_of, samples_schema

KEPT_VERSIONS = 2
MANIFEST = "path string, length long, modified timestamp, event string, data string, n_written long"
MOST_BROADCAST_FILES = 1_000_000


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Numbers of the versions below ``path``, and whether they were finished."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in files.globStatus(hadoop.Path(f"{path}/v-*")) or []:
        if number := re.fullmatch(r"v-(\d+)", status.getPath().getName()):
            found.append((int(number[1]), files.exists(hadoop.Path(status.getPath(), "_SUCCESS"))))
    return sorted(found)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest finished version of a table, None if there is none."""
    finished = [n for n, done in _versions(spark, path) if done]
    return f"{path}/v-{finished[-1]}" if finished else None


def write_version(frame: DataFrame, path: str, keep: int = KEPT_VERSIONS) -> str:
    """Write ``frame`` as the next version and drop all but the last ``keep`` finished ones.

    ``frame`` may read an earlier version of the table. Of two jobs that write the same version,
    the one that comes second fails.
    """
    spark = frame.sparkSession
    known = _versions(spark, path)
    target = f"{path}/v-{known[-1][0] + 1 if known else 1}"
    frame.write.parquet(target)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for number, _ in [v for v in known if v[1]][: 1 - keep or None]:
        old = hadoop.Path(f"{path}/v-{number}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return target


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    folder = current_version(spark, path)
    return spark.read.parquet(folder) if folder else None


@dataclass(frozen=True)
class Conversion:
    """What a run did: files converted, files known from before, files that are gone."""

    n_converted: int
    n_kept: int
    n_gone: int


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """CSV recordings below ``root`` with what tells whether they changed; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    path = F.col("path")
    kept = files.load(root).filter(in_class_folder(path) & in_folder_of(path, root))
    return kept.select("path", "length", F.col("modificationTime").alias("modified"))


def convert_changed(
    spark: SparkSession,
    root: str,
    output: str,
    schema: T.StructType = RAW_CSV_SCHEMA,
    layout: SeriesLayout = SeriesLayout(),
) -> Conversion:
    """Convert the CSV recordings that are new or changed since the last run into ``output``.

    The manifest, one row per file, says which data folder holds a file's rows. A run writes the
    rows of the files that the manifest does not know in this length and time to a folder of its
    own, then a new version of the manifest. Killed in between, it leaves a folder nobody names.
    """
    before = read_version(spark, f"{output}/manifest")
    before = spark.createDataFrame([], MANIFEST) if before is None else before
    same = ["path", "length", "modified"]
    listed = _listed(spark, root).persist()
    changed = listed.join(before, same, "left_anti")
    # Spark's own listing of the folder holds these names on the driver, too.
    paths = [r["path"] for r in changed.select("path").collect()]
    kept = before.join(listed.select(*same), same, "left_semi")
    counts = Conversion(len(paths), kept.count(), before.join(listed.select("path"), "path", "left_anti").count())
    if paths or counts.n_gone:
        data = uuid.uuid4().hex
        if paths:
            reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            samples = as_samples(reader.csv(paths), layout, root)
            samples.write.partitionBy(layout.code).parquet(f"{output}/data/{data}")
        new = changed.select(
            *same,
            event_key(decoded_path(F.col("path"))).alias("event"),
            F.lit(data).alias("data"),
            F.lit(len(paths)).cast("long").alias("n_written"),
        )
        write_version(kept.unionByName(new), f"{output}/manifest")
    listed.unpersist()
    return counts


def read_converted(spark: SparkSession, output: str, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """The samples of all files in the manifest's current version.

    Rows of files that changed or went since they were written are left out; folders without
    such rows are read as they are.
    """
    schema = samples_schema(layout)
    manifest = read_version(spark, f"{output}/manifest")
    samples = spark.createDataFrame([], schema)
    if manifest is None:
        return samples
    folders = manifest.groupBy("data").agg(F.count(F.lit(1)).alias("n"), F.max("n_written").alias("n_written")).collect()
    for folder in sorted(folders, key=lambda r: r["data"]):
        rows = spark.read.schema(schema).parquet(f"{output}/data/{folder['data']}")
        if folder["n"] < folder["n_written"]:
            live = manifest.filter(F.col("data") == folder["data"]).select(F.col("event").alias(layout.key))
            live = F.broadcast(live) if folder["n"] <= MOST_BROADCAST_FILES else live
            rows = rows.join(live, layout.key, "left_semi")
        samples = samples.unionByName(rows.select(*[col(c) for c in samples.columns]))
    return samples
