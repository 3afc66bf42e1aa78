"""From documents to token ids: language, quality, near-duplicates, mixture, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs.  Null texts go at the first stage, as their language is unknown; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import crf_language, curriculum_mix, forced_bpe, quality_rules, simhash_slices
from tidewatch.llm.queries import tokenizer_path
from tidewatch.llm.shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells."""
    return crf_language.filtered(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group."""
    return simhash_slices.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in training order."""
    return curriculum_mix.training_order(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and its place in the training order.

    The mixture is written by ranges of training time, so the number of a row's file, and its number there, order the
    rows; both are null for rows that come from no file.
    """
    text = docs["text"].alias("text")
    try:
        placed = docs.select(F.struct(docs["doc_id"], F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"), text)
        placed.schema  # noqa: B018 - tells whether the rows come from files
    except AnalysisException:
        none = F.lit(None)
        placed = docs.select(F.struct(docs["doc_id"], none.cast("int").alias("file"), none.cast("long").alias("row")).alias("at"), text)
    coded = forced_bpe.encode_decode(placed, tokenizer_path(), id_col="at", with_ids=True)
    return coded.select("at.*", *[c for c in coded.columns if c != "at"])


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("encoding", encoding)]

#: Language and near-duplicates have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
