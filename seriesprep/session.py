"""Session helpers: the shared folder, lineage cuts, and folders that a job removes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_job: ContextVar[str | None] = ContextVar("seriesprep_job", default=None)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall back to a
    temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="seriesprep-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder once and continue from the written copy.

    The copy is Parquet: compressed, and read again only in the columns that are used. Partition
    numbers do not survive it; what depends on them has to be a column before.
    """
    spark = frame.sparkSession
    path = f"{_job.get() or shared_folder(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """Everything written by :func:`cut_lineage` inside the block goes to one folder, which is
    removed at its end. Results that read from it must have been written elsewhere by then."""
    path = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    token = _job.set(path)
    try:
        yield path
    finally:
        _job.reset(token)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
