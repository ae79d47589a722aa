"""A corpus pipeline: documents in, what is left of them tokenised, each with its place in the mix.

Every stage works on all that the one before kept and is written as Parquet before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geochron.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from geochron.llm.shared import new_path, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those too ambiguous to name a language, go."""
    return language_id.known_documents(docs, language_id.learned(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_documents(exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"), rows=docs.count()), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, plain=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; the files hold them in the order in which a reader meets the target weights.  A reader of many files loses the order, which
    the last stage therefore writes down: a document's place follows from the documents that this stage keeps."""
    return mixing.interleaved(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens and its place in the mix: source, slot, position, and in_mix (before the first source runs out)."""
    names = mixing.own_columns(docs)
    wanted = {"_source": "source", "_slot": "slot", "_position": "position", "_in_mix": "in_mix"}
    placed = mixing.mixed(docs).select("doc_id", "text", *[F.col(names[k]).alias(v) for k, v in wanted.items()])
    return bpe.encoded(placed, more=tuple(wanted.values()))


STAGES = [("language_id", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mix), ("bpe", tokens)]
#: No SQL: language ID's classifiers, weighted sampling and BPE merges can't be put in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
