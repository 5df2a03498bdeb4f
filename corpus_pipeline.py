"""A training-corpus pipeline over documents: rules, perplexity, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderplan.llm import mixing, ngram_jaccard, packing, quality_lm, quality_rules, registry
from cinderplan.llm.common import new_folder, table
from cinderplan.ship import ship


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules accept.

    Null, empty and short texts fail; repeated rows are judged alike; an empty table gives an empty one; other columns pass through,
    whatever their names.
    """
    ship(spark)
    return quality_rules.accepted(docs)


def perplexity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold.

    Null and empty texts go; a text at the threshold stays; rows that agree in doc_id, lang and text are judged as one, null ids
    included; a null or unknown language takes the threshold of all; without trusted documents all with text stay.
    """
    ship(spark)
    return quality_lm.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least doc_id, once.

    Rows without words or with a null doc_id stay; texts under one doc_id are judged each; other columns pass through.
    """
    ship(spark)
    return ngram_jaccard.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's repetition rate says.

    A null source is one of its own; documents without words are taken at their source's rate; rows of one doc_id get one draw.
    """
    ship(spark)
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents' token ids in sequences; a null or empty text is the end id alone."""
    ship(spark)
    return packing.packed(docs, registry.tokenizer(), special=True)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", perplexity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: EM's iterations, MinHash, tokenization and heap packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
