"""Source texts as rows of tokens, and tokens as the streams of their bracket groups.

The stream of a group holds the tokens right inside a pair of brackets; of a
group inside it only the two brackets are seen.  So patterns that span brackets
are patterns of neighbours, whatever stands between the brackets, and of any
length: runs of rows, told apart by running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lex import lex

NAME = r"^#?[\p{L}_$][\p{L}\p{N}_$]*$"
#: After these a line's end does not end a statement.
_GOES_ON = ("(", "[", "{", ",", "=", "=>", ".", "?.", "...", "?", ":", "!", "~", "+", "-", "*", "/", "%", "<", ">", "&", "|", "^", "&&", "||", "??", "==", "!=", "===", "!==", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "**=", "&&=", "||=", "??=", "const", "let", "var", "new", "typeof", "case", "else", "do", "try", "in", "of", "extends", "implements", "instanceof", "export", "default", "import", "from", "async", "await", "static", "public", "private", "protected", "readonly", "abstract", "override", "get", "set", "function", "class", "interface", "enum", "void", "delete", "as", "@")
#: And these, at a line's beginning, go on with one.
_CARRIES_ON = (")", "]", "}", ",", ";", ".", "?.", "?", ":", "=", "=>", "(", "[", "{", "+", "-", "*", "/", "%", "<", ">", "&", "|", "^", "&&", "||", "??", "==", "!=", "===", "!==", "<=", ">=", "+=", "-=", "*=", "/=", "in", "of", "instanceof", "as", "extends", "implements", "else", "catch", "finally", "from")


#: Languages whose ``<name`` in place of a value begins no element.
_NO_ELEMENTS = ("typescript",)
_SCHEMA = "file_id string, i int, tok string, line int, col int, level int, step int, mate int, grp int"
#: Tokens of one batch of rows.
_ROWS = 50_000


def tokens(files: DataFrame) -> DataFrame:
    """(file_id, i, tok, line, col, level, step, mate, grp) of ``files`` (file_id, content, perhaps language), comments and white space left out.

    ``level`` counts the brackets around a token; a bracket has the level of what
    is inside, ``step`` 1 or -1, and ``mate``, the place of its other bracket.
    ``grp`` is the place of the bracket around a token, 0 for none.  Columns count
    UTF-8 bytes from 1.  Brackets are also ``${`` with its ``}``, the two ends of
    a template that holds one, and those of a JSX element (see :mod:`.lex`).
    Null contents have no tokens.
    """
    jsx = ~F.col("language").isin(*_NO_ELEMENTS) if "language" in files.columns else F.lit(True)
    texts = files.select("file_id", "content", F.coalesce(jsx, F.lit(True)).alias("jsx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file_id, text, elements = (batch.column(c)[k].as_py() for c in range(3))
                told, _ = lex(text or "", elements)
                for start in range(0, len(told), _ROWS):
                    part = told[start : start + _ROWS]
                    cols = list(zip(*part, strict=True))
                    rows = [pa.array([file_id] * len(part), pa.string()), pa.array(range(start + 1, start + len(part) + 1), pa.int32()), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:])]
                    yield pa.RecordBatch.from_arrays(rows, names=["file_id", "i", "tok", "line", "col", "level", "step", "mate", "grp"])

    return texts.mapInArrow(run, _SCHEMA)


def unbalanced(files: DataFrame) -> DataFrame:
    """``files`` (path, content, perhaps language, ...) whose brackets don't close: parsing tells little of them."""
    jsx = ~F.col("language").isin(*_NO_ELEMENTS) if "language" in files.columns else F.lit(True)
    texts = files.select("path", "content", F.coalesce(jsx, F.lit(True)).alias("jsx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [k for k in range(batch.num_rows) if not lex(batch.column(1)[k].as_py() or "", batch.column(2)[k].as_py())[1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(bad, pa.int64()))], names=["path"])

    return texts.mapInArrow(run, "path string")


def streams(t: DataFrame) -> DataFrame:
    """``t`` with ``grp`` (the bracket around it, 0 for none), its neighbours in the stream of that group, ``seg`` and ``sub``.

    q1 to q4 stand before, s1 to s3 behind.  ``seg`` numbers the statements of a
    group, ``sub`` their parts between commas.  A statement ends at a semicolon,
    behind a closing brace, or at a line's end where neither side goes on.
    """
    v = t.select("file_id", "grp", "i", "tok", "line", "col", "step", "mate")
    w = W.partitionBy("file_id", "grp").orderBy("i")
    near = {f"q{k}": F.lag("tok", k).over(w) for k in range(1, 5)} | {f"s{k}": F.lead("tok", k).over(w) for k in range(1, 4)}
    v = v.withColumns(near | {"q_line": F.lag("line").over(w), "s_i": F.lead("i").over(w)})
    # A decorator and what it decorates are one statement: runs of @name.name(...) are marked while they last.
    joins = F.col("tok").isin(".", "(", ")") | (F.col("q1") == ".") | (F.col("q1") == "@")
    run = F.sum(F.when(joins, 0).otherwise(1)).over(w)
    v = v.withColumn("run0", run)
    v = v.withColumn("deco", F.max(F.when(F.col("tok") == "@", 1).otherwise(0)).over(W.partitionBy("file_id", "grp", "run0")) == 1)
    after_deco = F.coalesce(F.lag("deco").over(w), F.lit(False))
    do = (F.col("tok") == "while") & (F.col("q1") == "}") & (F.coalesce(F.col("q3"), F.lit("")) == "do")
    line = (F.col("line") > F.col("q_line")) & ~F.col("q1").isin(*_GOES_ON)
    brace = (F.col("q1") == "}") & ~do
    begins = F.col("q1").isNull() | (F.col("q1") == ";") | ((line | brace) & ~F.col("tok").isin(*_CARRIES_ON) & ~do & ~after_deco)
    v = v.withColumn("seg", F.sum(F.when(begins, 1).otherwise(0)).over(w))
    sub = F.sum(F.when(F.col("q1") == ",", 1).otherwise(0)).over(W.partitionBy("file_id", "grp", "seg").orderBy("i"))
    return v.withColumn("sub", sub.cast("int")).drop("q_line", "run0")
