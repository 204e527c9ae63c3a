"""The corpus pipeline: stages over the documents table, each written as Parquet and read again for the next.

Every stage reads the columns of documents alone, whatever else a table has, and
all but the last return them.  Null and empty texts pass the filters and are
encoded as empty lists; repeated rows are judged alike; ties are settled by
doc_id, then by the text; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontam, jaccard, linededup, piece, quality
from tracemill.llm._shared import written
from tracemill.llm.queries import MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves too much go; null, empty and blank texts repeat nothing and stay."""
    return quality.quality_filter(docs.select(*COLUMNS))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are near copies of earlier ones go, and documents of which nothing is left; null, empty and blank texts stay. n_chars is that of the text that is left."""
    return linededup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id; a null id or text is in no group."""
    return jaccard.keep_one_of_each_group(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; an empty benchmark removes nothing."""
    return decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, ids, n_ids): the texts as SentencePiece ids; a null or empty text has none."""
    return piece.encode(docs.select(*COLUMNS), piece.PieceModel.load(MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: SQL can't express the last stage; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if k < len(STAGES) - 1:
            df = written(df, f"stage{k}")
    return df
