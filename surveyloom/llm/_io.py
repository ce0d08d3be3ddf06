"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; a temporary one only where none is set and Spark is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="surveyloom-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The table written as Parquet to the shared folder and read back, and its path.

    Cuts lineage: after the loss of an executor nothing before this table runs again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(result: DataFrame) -> None:
    """Remove all tables of ``written`` that a result reads, once it is not needed any more.

    Operators drop what they wrote on the way themselves; what their result reads stays for
    their callers to drop.  Other files that the result reads are left alone.
    """
    folder = shared_folder(result.sparkSession).rstrip("/")
    name = re.compile(re.escape(folder.rpartition(":")[2].lstrip("/")) + r"/(table-[0-9a-f]{32})/")
    for table in sorted({m[1] for f in result.inputFiles() if (m := name.search(f))}):
        dropped(result.sparkSession, f"{folder}/{table}")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives unused memory back to the system at its end, as its worker may wait long for another task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied
