"""Versions of a whole store: one file tells which folders all its tables consist of.

A table has named parts (an application's nodes, say), a part is a folder of
Parquet files that is never changed.  A change writes new folders, then a file
with the number after that of the version it began from; naming that file is the
only step that readers see, and fails where another writer was first.  What a
failed change has written is named by nothing, so readers never meet it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Tables by name, their parts by name; None takes a part away.
Changes = dict[str, dict[str, DataFrame | None]]


class Conflict(Exception):
    """Another writer named the next version first."""


@dataclass(frozen=True)
class Version:
    """``parts``: table, part, folder; ``columns``: all columns that parts of a table have or had."""

    number: int = 0
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    columns: dict[str, dict] = field(default_factory=dict)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> Version:
    """The version of the highest number; an empty one before the first."""
    place, fs = _folder(spark, path)
    if not fs.exists(place):
        return Version()
    names = [n for n in (s.getPath().getName() for s in fs.listStatus(place)) if n.endswith(".json") and n[0].isdigit()]
    if not names:
        return Version()
    told = json.loads(spark.read.text(f"{path}/versions/{max(names)}", wholetext=True).first()[0])
    return Version(told["number"], told["parts"], told["columns"])


def _joined(old: dict | None, new: StructType, table: str) -> dict:
    """Columns of both; one name with two types is an error, before anything is named."""
    known = {f.name: f for f in StructType.fromJson(old).fields} if old else {}
    for f in new.fields:
        had = known.setdefault(f.name, StructField(f.name, f.dataType, True))
        if had.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} of {table} is {had.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return json.loads(StructType(list(known.values())).json())


def _write(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def _name(spark: SparkSession, path: str, version: Version) -> None:
    """Write the version's file under another name, then rename it; a file that is there already stays."""
    place, fs = _folder(spark, path)
    fs.mkdirs(place)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, draft = (hadoop.Path(f"{path}/versions/{name}") for name in (f"{version.number:012d}.json", f"draft-{uuid.uuid4().hex}"))
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"number": version.number, "parts": version.parts, "columns": version.columns}).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if not fs.exists(target):
            raise
        fs.delete(draft, False)
        raise Conflict(f"version {version.number} of {path}") from e


def commit(spark: SparkSession, path: str, base: Version, changes: Changes) -> Version:
    """The version after ``base``: with the parts of ``changes`` in place of its own, all at once."""
    parts, columns = {t: dict(p) for t, p in base.parts.items()}, dict(base.columns)
    for table, pieces in changes.items():
        for part, df in pieces.items():
            if df is None:
                parts.get(table, {}).pop(part, None)
                continue
            columns[table] = _joined(columns.get(table), df.schema, table)
            folder = f"{table}/{uuid.uuid4().hex}"
            _write(df, f"{path}/{folder}")
            parts.setdefault(table, {})[part] = folder
    version = Version(base.number + 1, parts, columns)
    _name(spark, path, version)
    return version


def update(spark: SparkSession, path: str, change: Callable[[Version], Changes], tries: int = 5) -> Version:
    """:func:`commit` what ``change`` makes of the latest version, anew where another writer was first."""
    for n in range(tries):
        base = latest(spark, path)
        try:
            return commit(spark, path, base, change(base))
        except Conflict:
            if n == tries - 1:
                raise
    raise ValueError(f"tries {tries}")


def read(spark: SparkSession, path: str, table: str, version: Version | None = None, part: str | None = None) -> DataFrame | None:
    """A table, or one part of it, with all its columns; None where there is none."""
    version = version or latest(spark, path)
    folders = [f for p, f in version.parts.get(table, {}).items() if part is None or p == part]
    if not folders:
        return None
    return spark.read.schema(StructType.fromJson(version.columns[table])).parquet(*(f"{path}/{f}" for f in sorted(folders)))
