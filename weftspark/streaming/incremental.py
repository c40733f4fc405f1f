"""Files that arrive are parsed once by their path and hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import readable


def changed_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of source files as they come into ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(base + "/"), F.lit(r"\E")), 2), -1)
    return raw.filter(readable(relative)).withColumn("hash", F.sha2("content", 256))


def only_new(batch: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, hash) is not in the cache of parsed ones."""
    return batch.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")


def keep_parsed(files: DataFrame, parse: Callable[[DataFrame], DataFrame], cache_path: str, checkpoint: str) -> StreamingQuery:
    """Parse each new version of a file once; ``parse`` keeps path and hash.

    What earlier batches have parsed is left out.  A batch that is run again
    overwrites its own part of the cache, and does not count that part as earlier.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        new = batch
        if there:
            earlier = spark.read.parquet(cache_path).filter(F.col("batch") < number)
            new = only_new(batch, earlier)
        parse(new.dropDuplicates(["path", "hash"])).write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
