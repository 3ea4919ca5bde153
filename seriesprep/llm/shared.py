"""Tables, the shared folder and column helpers that several operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesprep.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def job_path(spark: SparkSession, what: str) -> str:
    """A new path for one intermediate table in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, what: str) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read back: a lost executor costs no
    recomputation, and later readers get column pruning."""
    spark = frame.sparkSession
    path = job_path(spark, what)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``frame`` has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checked_broadcast(frame: DataFrame, most_rows: int) -> DataFrame:
    """``frame`` marked for broadcast if it has at most ``most_rows`` rows; the same rows else."""
    return F.broadcast(frame) if frame.count() <= most_rows else frame
