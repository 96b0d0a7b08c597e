"""From raw documents to a training set: the stages, each one operator applied to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.llm import chosenpath, common, decontaminate, language, linechunks, mixing
from counterpoise.workspace import materialize


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or with tied languages go."""
    model = language.fit(docs.where(common.learnable("doc_id", 4, 2)))
    told = language.classify(docs, model)
    return told.where(~F.col(told.columns[-1])).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a document of which less than a passage is left goes."""
    cleaned = linechunks.remove_repeats(docs)
    removed = F.col(cleaned.columns[-1])
    left = F.size(F.regexp_extract_all("text", F.lit(mixing.WORDS), F.lit(0)))
    return cleaned.where((removed == 0) | (left >= linechunks.MIN_WORDS)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return chosenpath.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; a document that is mostly such passages goes."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of the documents that has the wanted shares of sources, languages and topics."""
    drawn = mixing.mix(docs)
    return drawn.where(F.col(drawn.columns[-1])).select(*docs.columns)


STAGES = [
    ("language", by_language),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: The first stage compares sizes of zstandard frames, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
