"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import materialise, shared_path, shared_root

__all__ = ["SPACE", "discard", "free_name", "materialise", "partition_count", "shape", "shared_path", "shared_root", "slices", "task_number", "text_bytes", "text_key"]

#: ``[\x20\x09-\x0D]``, the white space of all contracts here.
SPACE = b" \t\n\x0b\x0c\r"


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        root = shared_root(spark)
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if "/weftspark/" in folder and folder.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partition_count(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_key() -> F.Column:
    """With ``doc_id``, identifies a row: rows that share both are repeats of each other."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def shape(df: DataFrame) -> T.StructType:
    """The schema of ``df`` with every column nullable, for results of tasks."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one slice holds about ``limit`` bytes of ``column``; a longer row is a slice alone.

    Spark itself ends a batch at ``spark.sql.execution.arrow.maxBytesPerBatch``
    (64 MB unless set), so that a batch of long texts is bounded too.
    """
    start, size = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
