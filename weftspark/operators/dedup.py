"""Ordered deduplication: who comes first or last is told by an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the least by ``order``; summed up within tasks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*").select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*").select(*df.columns)


def edge_set(edges: DataFrame) -> DataFrame:
    """Edges without a location are a set by (type, src, dst), the first wins; those with one are a bag."""
    placed = edges.filter("loc is not null")
    return first_wins(edges.filter("loc is null"), ["type", "src", "dst"], ["seq"]).unionByName(placed)


def merge_properties(df: DataFrame, keys: list[str], properties: list[str], order: str = "seq") -> DataFrame:
    """One row of each key; each property is the last that is not null."""
    return df.groupBy(*keys).agg(*(F.max_by(p, F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in properties))
