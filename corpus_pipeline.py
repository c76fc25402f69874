"""The corpus pipeline: language ID, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents, whatever else
these are called. SQL can't express the stages, so ORACLE_SQL is None and
``tests/llm/test_pipeline.py`` holds them against brute-force versions. Texts are
taken whole, however long. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm.langid import recognised
from auralake.llm.line_runs import dedup_lines
from auralake.llm.near_copies import keep_first
from auralake.llm.packing import digests, pack_documents
from auralake.llm.session import materialise
from auralake.llm.tiling import uncontaminated

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those unlike every labelled language.

    Null and blank texts go. Rows with a null key or label are judged but not
    learned from; rows that repeat are judged alike; without any label all go.
    """
    return recognised(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of lines, alone or in runs; documents of which nothing else is left go.

    The first place is that of the least key (nulls last), then of the least hash
    of the text. Rows of equal key and text are one document and stay alike. Null
    and blank texts have no lines and stay.
    """
    found = dedup_lines(docs, min_lines=1).where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    renewed = {"text": F.col("kept"), "n_chars": F.when(F.col("n_deleted") == 0, F.col("n_chars")).otherwise(F.char_length("kept")).cast("long")}
    return found.select(*[renewed[c].alias(c) if c in renewed else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of texts alike in 0.8 of their five-word shingles.

    Vantage-point trees of SimHash fingerprints find them, whole shingle sets decide.
    Null and blank texts are one group. Null keys come last; of rows of equal key
    the one with the least hash of its text stays, of equal rows one.
    """
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null, blank and short texts hold none and stay, as do null keys; rows that repeat fare alike.
    """
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens; a digest of each piece.

    Null and blank texts are the end id alone. Rows that repeat, or have no key, are packed each on its own.
    """
    return digests(pack_documents(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
