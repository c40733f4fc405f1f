"""Tables written in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []
#: Times that rows in memory may be as large as their Parquet file.
PACKED = 64


def shared_root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only where that is unset in local mode (tests) a temporary folder, one a process.

    On a cluster, a folder of the driver's own would lose rows: there it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="weftspark-"))
        root = _own_root[0]
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/weftspark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written = path
    return written


@contextmanager
def joined_by_size(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are joined by the sizes that rows have, not by those of files; the session's settings come back at the end.

    Tokens and places pack so well that Spark takes hundreds of MB for less than its limit of broadcasts, and would
    gather them on the driver.  So only files are broadcast that stay below the limit when unpacked; what is larger is
    shuffled, and broadcast if adaptive execution then sees that it is small.  Holds for :func:`materialise`, not for what is returned unwritten.
    """
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if most > 0:
        spark.conf.set(names[0], str(most // PACKED))
        spark.conf.set(names[1], before[names[1]] or str(most))
    try:
        yield
    finally:
        for name, value in before.items() if most > 0 else ():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialised tables that no later step reads; others are left as they are."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def counted(df: DataFrame, name: str, test: str = "true") -> tuple[DataFrame, int]:
    """:func:`materialise`, and how many rows pass ``test``, counted while they are written: a loop needs no job of its own to see whether it has ended."""
    seen = Observation()
    written = materialise(df.observe(seen, F.count_if(F.expr(test)).alias("n")), name)
    return written, int(seen.get["n"])
