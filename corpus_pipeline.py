"""A corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwork.llm.common import written
from chartwork.llm.decontamination import drop_leaks
from chartwork.llm.jaccard import near_duplicates_dropped
from chartwork.llm.langid import fit_languages, identify
from chartwork.llm.mixing import mixed
from chartwork.llm.sharding import shard_documents

#: Least part of a text's n-grams that the predicted language's filter must have.
LEAST_SCORE = 0.1
#: Rows of one file that are numbered together, at most.
RUN_ROWS = 50_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages go on.

    Those go whose text is null or has no letter (``und``), and those of which the filter of the predicted language
    has less than LEAST_SCORE of the n-grams: they are in none of them. If no row has a language, nothing is learned
    and only texts without a letter go. An empty table gives an empty one; rows of a null doc_id are judged alike.
    """
    names = docs.columns
    filters = fit_languages(docs)
    if not filters.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs.toDF(*[f"_{i}" for i in range(len(names))]), filters, text=f"_{names.index('text')}")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that of the least doc_id.

    A text without words, and a row without doc_id, is in no group and stays; an empty table gives an empty one.
    """
    return near_duplicates_dropped(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a null or empty text holds none and stays."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the interleaved order of their sources: that of the files by name, and of rows in each file."""
    return mixed(docs)


def read_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_run`` and ``_at``, which order the rows as their files do; rows from elsewhere are written first.

    A scan packs files by size, so the order of files is by name; runs are cut so that none grows with its file.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = written(docs, "ordered")
    docs = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return docs.withColumn("_run", F.struct("_file", F.expr(f"_at div {RUN_ROWS}").alias("part"))).drop("_file")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and its slot there; slots follow the order in which mixing wrote the documents."""
    return shard_documents(read_order(docs), n_shards=40, order=("_run", "_at"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The n-gram filters and the edit search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
