"""What an application shows to others: endpoints, environment variables, hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import env_name, hosts_in

#: How many of each an application lists, the first in order.
MOST = {"endpoints": 50, "env_vars_read": 20, "host_candidates": 20}


def listed(values: DataFrame, name: str) -> DataFrame:
    """app_key and its distinct ``value``s in order, as many as the signal allows.

    Values are made distinct before they are gathered, so a task gets each once.
    """
    each = values.filter("value is not null and value <> ''").distinct()
    return each.groupBy("app_key").agg(F.slice(F.array_sort(F.collect_list("value")), 1, MOST[name]).alias(name))


def endpoint_values(endpoints: DataFrame) -> DataFrame:
    return endpoints.select("app_key", F.concat_ws(" ", F.upper("method"), "path").alias("value"))


def env_values(reads: DataFrame) -> DataFrame:
    """From READS edges (app_key, target_name, member): members of ``process`` alone."""
    return reads.filter("target_name = 'process'").select("app_key", env_name(F.col("member")).alias("value"))


def host_values(texts: DataFrame) -> DataFrame:
    """From source texts (app_key, content)."""
    return texts.select("app_key", F.explode(hosts_in(F.col("content"))).alias("value"))


def with_signals(applications: DataFrame, endpoints: DataFrame, reads: DataFrame, texts: DataFrame) -> DataFrame:
    """``applications`` with their three lists; applications that only signals know are added."""
    out = applications
    for name, values in (("endpoints", endpoint_values(endpoints)), ("env_vars_read", env_values(reads)), ("host_candidates", host_values(texts))):
        out = out.drop(name).join(listed(values, name), "app_key", "full_outer")
    lists = {n: F.coalesce(F.col(n), F.array().cast("array<string>")) for n in MOST}
    return out.withColumn("id", F.coalesce("id", F.concat(F.lit("app:"), "app_key"))).withColumns(lists)
