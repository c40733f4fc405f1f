"""Code property graphs as Spark DataFrames: parse, link, enrich, store, ask."""

from .model import Graph

__all__ = ["Graph"]
