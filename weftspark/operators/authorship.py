"""Commits, people and who owns which declaration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import change_kind, person_id, stored_email
from .spans import innermost

#: Declarations that people own.
OWNABLE = ("Function", "Class", "Interface", "Field", "Enum", "EnumMember")


def ownable(nodes: DataFrame) -> DataFrame:
    """Declarations that can be owned: these types, and variables that a file declares itself."""
    return nodes.filter(F.col("type").isin(*OWNABLE) | ((F.col("type") == "Variable") & F.col("owner_id").rlike(r"\.(ts|js|tsx|jsx)$")))


def people(log: DataFrame, policy: str = "plain") -> DataFrame:
    """One Person per address; the name of the first commit (by pos), authors before committers, stays."""
    both = log.select("pos", F.lit(0).alias("part"), F.col("author_name").alias("n"), F.col("author_email").alias("e")).unionByName(log.select("pos", F.lit(1).alias("part"), F.col("committer_name").alias("n"), F.col("committer_email").alias("e")))
    known = both.select(person_id(F.col("n"), F.col("e")).alias("id"), F.trim("n").alias("name"), stored_email(F.col("e"), policy).alias("email"), "pos", "part")
    return known.groupBy("id").agg(F.min_by(F.struct("name", "email"), F.struct("pos", "part")).alias("p")).select("id", F.lit("Person").alias("type"), "p.*")


def commit_nodes(log: DataFrame) -> DataFrame:
    return log.select(F.concat(F.lit("commit:"), "sha").alias("id"), F.lit("Commit").alias("type"), "sha", F.col("subject").alias("message"), "authored_at", "committed_at", F.nullif(F.substring_index("parents", " ", 1), F.lit("")).alias("parent"))


def commit_edges(log: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """AUTHORED_BY, COMMITTED_BY (only of someone else) and CHANGED to the files (id, path) that are in the graph."""
    commit = F.concat(F.lit("commit:"), "sha")
    none = F.lit(None).cast("string")
    author, committer = person_id(F.col("author_name"), F.col("author_email")), person_id(F.col("committer_name"), F.col("committer_email"))
    authored = log.select(F.lit("AUTHORED_BY").alias("type"), commit.alias("src"), author.alias("dst"), none.alias("kind"), none.alias("member"))
    committed = log.filter(author != committer).select(F.lit("COMMITTED_BY").alias("type"), commit.alias("src"), committer.alias("dst"), none.alias("kind"), none.alias("member"))
    changed = changes.join(log.select("sha").distinct(), "sha", "left_semi").join(files.select(F.col("id").alias("file_id"), "path"), "path")
    told = changed.select(F.lit("CHANGED").alias("type"), commit.alias("src"), F.col("file_id").alias("dst"), change_kind(F.col("status")).alias("kind"), F.nullif("renamed_from", F.lit("")).alias("member"))
    return authored.unionByName(committed).unionByName(told)


def owned_lines(blame: DataFrame, declarations: DataFrame) -> DataFrame:
    """(decl, person, line, time) from ``blame`` (file_id, line, person, time) and spans of declarations: each line goes to the innermost."""
    return innermost(blame, declarations).select(F.col("span_id").alias("decl"), "person", "line", "time")


def shares(lines: DataFrame) -> DataFrame:
    """(decl, person, n, share) of lines (decl, person, ...)."""
    each = lines.groupBy("decl", "person").agg(F.count(F.lit(1)).alias("n"))
    # The sum of sums joins few rows: one for each declaration and person.
    total = each.groupBy("decl").agg(F.sum("n").alias("all"))
    return each.join(total, "decl").select("decl", "person", "n", (F.col("n") / F.col("all")).alias("share"))


def created_modified(lines: DataFrame) -> DataFrame:
    """(decl, created_by, modified_by): people of the first and the last change; ties go to the lowest line."""
    return lines.groupBy("decl").agg(F.min_by("person", F.struct("time", "line")).alias("created_by"), F.max_by("person", F.struct("time", (-F.col("line")).alias("line"))).alias("modified_by"))


def ownership_edges(lines: DataFrame) -> DataFrame:
    owns = shares(lines).select(F.lit("OWNS").alias("type"), F.col("person").alias("src"), F.col("decl").alias("dst"), F.lit("blame").alias("kind"), "share")
    who = created_modified(lines)
    none = F.lit(None).cast("double")
    made = who.select(F.lit("CREATED").alias("type"), F.col("created_by").alias("src"), F.col("decl").alias("dst"), F.lit("blame").alias("kind"), none.alias("share"))
    last = who.select(F.lit("LAST_MODIFIED").alias("type"), F.col("modified_by").alias("src"), F.col("decl").alias("dst"), F.lit("blame").alias("kind"), none.alias("share"))
    return owns.unionByName(made).unionByName(last)
