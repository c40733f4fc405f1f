"""Points in nested line ranges, and ranges that meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a bucket: a range meets the points of the buckets that it touches.
BUCKET = 64


def _dealt(spans: DataFrame, bucket: int) -> DataFrame:
    """Valid spans, one row for each bucket of lines that they touch.

    Spans without a file, before line 1 or that end before they begin don't count.
    """
    valid = spans.filter("file_id <> '' and start_line > 0 and end_line >= start_line")
    at = F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("bucket")
    return valid.select("*", at)


def within(points: DataFrame, spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``points`` (file_id, line, ...) with each of ``spans`` (span_id, file_id, start_line, end_line) around them.

    An equal join on file and bucket of lines: no range is compared across files,
    nor with far lines of a long file.
    """
    return points.withColumn("bucket", F.floor(F.col("line") / bucket)).join(_dealt(spans, bucket), ["file_id", "bucket"]).filter("line between start_line and end_line").drop("bucket")


def innermost(points: DataFrame, spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``points`` (file_id, line, ...) with span_id of the shortest of ``spans`` (span_id, file_id, start_line, end_line, seq) around the line.

    Ties go to the smallest seq.  Points outside of all spans are left out;
    repeated points stay.
    """
    met = within(points.select("file_id", "line").distinct(), spans.select("span_id", "file_id", "start_line", "end_line", "seq"), bucket)
    best = met.groupBy("file_id", "line").agg(F.min_by("span_id", F.struct(F.expr("end_line - start_line"), "seq")).alias("span_id"))
    return points.join(best, ["file_id", "line"])


def overlapping(ranges: DataFrame, spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``ranges`` (range_id, file_id, first_line, last_line) with the span_id of each most specific of ``spans`` that they touch.

    A span is left out where another one inside of it covers all of the range that it does.
    """
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first_line") / bucket), F.floor(F.col("last_line") / bucket))))
    met = r.join(_dealt(spans.select("span_id", "file_id", "start_line", "end_line", "seq"), bucket), ["file_id", "bucket"]).filter("first_line <= end_line and start_line <= last_line").drop("bucket").distinct()
    met = met.withColumns({"a": F.greatest("first_line", "start_line"), "b": F.least("last_line", "end_line")})
    inner = met.select("range_id", "file_id", F.col("span_id").alias("inner"), F.col("a").alias("ia"), F.col("b").alias("ib"), (F.col("end_line") - F.col("start_line")).alias("size"), F.col("seq").alias("inner_seq"))
    covered = met.join(inner, ["range_id", "file_id"]).filter("inner <> span_id and ia <= a and ib >= b and (size < end_line - start_line or (size = end_line - start_line and inner_seq < seq))")
    return met.join(covered.select("range_id", "span_id").distinct(), ["range_id", "span_id"], "left_anti").select("range_id", "file_id", "span_id")
