"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

``STAGES`` are (name, function of (spark, docs, sf_dir)); ``run`` writes each
stage's result as Parquet into the shared checkpoint folder and reads it back
as the next one's documents.  All stages but the last return the columns of
``documents``.

Defined cases are those of the operators; of rows that are like each other one
stays, also where they share an id or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckscope.llm import line_dedup, ngram_join, piece_viterbi, quality_cascade, string_tiling
from deckscope.llm.queries import model_bytes, tokenizer_path
from deckscope.llm.shared import col, free_name, read_documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_cascade.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more share; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of like ones: the smallest id (none comes last), then the first row; rows without words are like none.

    Decided by row, not by id: rows are numbered, and the numbered rows stored, before they are compared."""
    row = free_name(docs.columns, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    alike = ngram_join.join_similar(numbered, row).select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = alike.where("row <> component_id").select("component_id").distinct()
    members = stored(alike.join(groups, "component_id").join(ids, "row"), "alike")
    stays = members.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "row")).alias("least")).select(F.col("least.row").alias("row"))
    gone = members.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*(col(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no test item contaminates."""
    return string_tiling.drop_contaminated(docs, read_documents(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, round_trip, ids`` of every document."""
    return piece_viterbi.encode_documents(docs, model_bytes(tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", piece_encoding),
]

#: SQL can't express the last stage; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return stored(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
