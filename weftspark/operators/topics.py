"""Message topics that source texts name, and the functions that produce or consume them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from .spans import innermost


def scan_calls(files: DataFrame) -> DataFrame:
    """(file_id, at, line, callee, method, raw) of topic calls in ``files`` (file_id, content), also over several lines.

    Spark's functions don't tell where a match stands, so this one scan is a small pandas function.
    """
    import re

    patterns = [re.compile(p) for p in (fn.TOPIC_POSITIONAL, fn.TOPIC_OBJECT)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, k, m.start(), 1 + t.count("\n", 0, m.start()), m[1], m[2], m[3]) for f, t in zip(batch.file_id, batch.content, strict=True) for k, p in enumerate(patterns) for m in p.finditer(t or "")]
            yield pd.DataFrame(rows, columns=["file_id", "form", "at", "line", "callee", "method", "raw"])

    return files.select("file_id", "content").mapInPandas(run, "file_id string, form int, at long, line int, callee string, method string, raw string")


def line_calls(lines: DataFrame) -> DataFrame:
    """The same for texts cut into lines (file_id, line, content), by Spark's functions alone: one call a line at most."""
    pattern = fn.TOPIC_POSITIONAL
    return lines.filter(F.col("content").rlike(pattern)).select("file_id", "line", *(F.regexp_extract("content", pattern, i).alias(n) for i, n in ((1, "callee"), (2, "method"), (3, "raw"))))


def topic_hits(calls: DataFrame) -> DataFrame:
    """(file_id, line, broker, name, action), each once."""
    known = calls.withColumn("broker", fn.broker_of(F.col("callee")))
    named = known.withColumn("name", fn.topic_name(F.col("raw"), F.col("broker"))).filter("name <> ''")
    action = F.when(F.col("method").isin(*fn.CONSUMES), "CONSUMES").otherwise("PRODUCES")
    return named.select("file_id", F.col("line").cast("long").alias("line"), "broker", "name", action.alias("action")).distinct()


def topic_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """PRODUCES and CONSUMES (src, dst, line) from the innermost of ``functions`` around a call; calls outside of all are dropped."""
    held = innermost(topic_hits(calls), functions)
    topic = F.concat(F.lit("topic:"), "broker", F.lit(":"), "name")
    return held.select(F.col("action").alias("type"), F.col("span_id").alias("src"), topic.alias("dst"), "line", F.lit("inferred").alias("resolution"))


def topic_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("id"), F.lit("Topic").alias("type"), F.split("dst", ":", 3)[1].alias("broker"), F.split("dst", ":", 3)[2].alias("name")).distinct()
