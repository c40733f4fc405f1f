"""A graph over time: what changed between two versions, and what was valid when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.confidence import rank


def semantic_diff(old: DataFrame, new: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(id, change) between declarations (id, signature, body): added, removed, signature or body.

    With ``renames`` (old_file, new_file) declarations of a renamed file keep their
    identity and are told as renamed if nothing else changed; with a column place
    in both, those of which only that differs are told as moved.
    """
    placed = "place" in old.columns and "place" in new.columns
    was = old.withColumn("was", F.col("id"))
    was = was if renames is None else renamed(was, renames)
    o, n = (df.select("id", F.col("signature").alias(f"s{i}"), F.col("body").alias(f"b{i}"), (F.col("place") if placed else F.lit(None)).alias(f"p{i}"), *more) for i, (df, more) in enumerate(((was, ["was"]), (new, []))))
    both = o.withColumn("in0", F.lit(True)).join(n.withColumn("in1", F.lit(True)), "id", "full_outer")
    change = (
        F.when(F.col("in0").isNull(), "added")
        .when(F.col("in1").isNull(), "removed")
        .when(~F.col("s0").eqNullSafe(F.col("s1")), "signature")
        .when(~F.col("b0").eqNullSafe(F.col("b1")), "body")
        .when(F.col("was") != F.col("id"), "renamed")
        .when(~F.col("p0").eqNullSafe(F.col("p1")), "moved")
    )
    return both.select("id", change.alias("change")).filter("change is not null")


def bag_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows with n, how many more (or, below 0, fewer) there are than before: one aggregation of signed counts."""
    signed = new.withColumn("n", F.lit(1)).unionByName(old.withColumn("n", F.lit(-1)))
    return signed.groupBy(*new.columns).agg(F.sum("n").alias("n")).filter("n <> 0")


def dependency_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows more or fewer than before, as bags."""
    each = bag_difference(old, new).withColumn("change", F.when(F.col("n") > 0, "added").otherwise("removed"))
    return each.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n")))).drop("n")


def validity(versions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``versions`` with valid_from and valid_to: the next version's order, null for the last."""
    w = W.partitionBy(*keys).orderBy(order)
    return versions.withColumn("valid_from", F.col(order)).withColumn("valid_to", F.lead(order).over(w))


def as_of(valid: DataFrame, moment: F.Column) -> DataFrame:
    return valid.filter((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def hotspots(changes: DataFrame, most: int = 20) -> DataFrame:
    """Declarations (decl) of the most distinct commits, with their number of authors: a top list."""
    n = changes.groupBy("decl").agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"))
    return n.orderBy(F.desc("commits"), F.desc("authors"), "decl").limit(most)


def renamed(df: DataFrame, renames: DataFrame, column: str = "id") -> DataFrame:
    """Ids rewritten by ``renames`` (old_file, new_file): the part before ``#`` is the file."""
    r = renames.select(F.col("old_file").alias("__f"), F.col("new_file").alias("__n"))
    file = F.substring_index(column, "#", 1)
    joined = df.join(r, file == F.col("__f"), "left")
    rest = F.expr(f"substr({column}, 1 + length(substring_index({column}, '#', 1)))")
    return joined.withColumn(column, F.when(F.col("__n").isNotNull(), F.concat("__n", rest)).otherwise(F.col(column))).drop("__f", "__n")


def suspects(cone: DataFrame, changes: DataFrame, most: int = 10) -> DataFrame:
    """Changes (node, changed) inside a failure's ``cone`` (start, node, distance): the top of each start.

    Nearest first; then by kind (dependencies and signatures, bodies, what is new)
    and by how sure the way is (resolution), where there are such columns; then newest.
    """
    kind = F.when(F.col("kind").isin("deps", "signature"), 0).when(F.col("kind") == "body", 1).when(F.col("kind") == "added", 2).otherwise(3)
    order = ["distance", *([kind] if "kind" in changes.columns else []), *([rank(F.col("resolution"))] if "resolution" in cone.columns else []), F.desc("changed"), "node"]
    w = W.partitionBy("start").orderBy(*order)
    return cone.join(changes, "node").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
