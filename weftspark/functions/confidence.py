"""How sure a link is: exact, inferred, name_only, and ambiguous choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank(resolution: Column) -> Column:
    return F.when(resolution == "inferred", 1).when(resolution == "name_only", 2).otherwise(0)


def weaker(a: Column, b: Column) -> Column:
    """``b`` where it is less sure than ``a``, else ``a``."""
    return F.when(rank(b) > rank(a), b).otherwise(a)


def choice(count: Column, best: Column, second: Column) -> Column:
    """Resolution of the best of ranked candidates: exact alone with a score of 2, ambiguous when the next ties."""
    return F.when(count == 0, F.lit(None)).when((count > 1) & (second == best), "ambiguous").when((count == 1) & (best >= 2), "exact").otherwise("inferred")
