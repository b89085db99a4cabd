"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it as the next stage's
documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetclean.llm import contamination, language, mix, set_join, shard
from assetclean.llm.common import cut, table

#: bits per symbol above which no learned language explains a text
MAX_ENTROPY = 6.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; what
    has no letters, or fits none of them, goes."""
    model = language.train_model(docs, usable=~language.held_out(F.col("doc_id")))
    said = language.predict(docs, model)
    return said.filter((F.col("_lang_pred") != language.UNKNOWN) & (F.col("_entropy") <= MAX_ENTROPY)).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of linked documents."""
    return set_join.keep_one(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mix.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return shard.shard_rows(docs).select("row.*", "size", F.col("crc").alias("text_crc32"), "position", "shard", "slot")


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", contamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The first stage has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{k + 1}")
    return docs
