"""Quality rules, line dedup, near-duplicates, secrets, packing: a corpus from documents to sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import linededup, neardup, packing, quality, secrets
from weftspark.llm.common import materialise


def _counted(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``docs``' columns; ``n_chars`` counts the text anew, where there is such a column."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


#: What holds for all stages: repeated rows stay as often as there are; a long text is read whole; an empty
#: table gives an empty one; columns of any name stay, in their order (the last stage has columns of its own).


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go.

    A null or empty text has no words, fails and goes.  Rows without a language are
    a stratum of their own.  Rows that share a doc_id, or have none, stay if any of
    them passes.  Without labels only the base rules reject.
    """
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document that has lost all lines stays, empty.

    A null text stays null.  Of documents that share the smallest doc_id, and of a
    document's own repeats, all keep the line.
    """
    return _counted(docs, linededup.keep_lines(docs, linededup.keep_bitmaps(docs)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (at least 0.8 of their five-word shingles alike) the document of smallest doc_id stays.

    Documents without words are near nothing and all stay; so do rows without a
    doc_id, and all rows of the smallest one.
    """
    return neardup.drop_near_copies(docs, size=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null texts as null."""
    return _counted(docs, secrets.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids: one row per piece, with its ids.

    Null and empty texts are the end id alone; documents at one place of the curve
    stand by doc_id, then as read.  Columns of the documents are left out.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: SQL can't tell thresholds, signatures or tokens: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before kept, written in between; what they say of odd rows holds for the whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
