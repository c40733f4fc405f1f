"""Source files of a folder, with what is read pruned by path before any content is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of, readable


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), language, hash (sha256), content (bytes) of the code files under ``root``.

    The first filter is on the files' metadata: Spark drops the others from its
    list before any is opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = lambda column: F.element_at(F.split(column, F.concat(F.lit(r"\Q"), F.lit(base + "/"), F.lit(r"\E")), 2), -1)
    listed = raw.filter(readable(relative(F.col("_metadata.file_path"))))
    told = listed.select(relative(F.col("path")).alias("path"), "content").filter(readable(F.col("path")))
    return told.select("path", language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), "content")


def texts(files: DataFrame) -> DataFrame:
    return files.withColumn("content", F.decode("content", "UTF-8"))


def one_file(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def read_graph_json(spark: SparkSession, path: str) -> DataFrame:
    """Application rows of a graph written as one JSON document."""
    nodes = spark.read.json(path, multiLine=True).select(F.explode("nodes").alias("n")).select("n.*")
    return nodes.filter("type = 'Application'")
