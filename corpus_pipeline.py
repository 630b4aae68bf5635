"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has written, and
gives a DataFrame; all but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import langid, mixing, neardup, packing, pii
from chronoloom.llm.common import cut, table
from chronoloom.llm.queries import tokenizer_path

#: Share of the remaining tokens that the mixture keeps.
MIXTURE_SHARE = 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known from the labelled ones; those without go."""
    return langid.accepted(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; the length follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked shares of sources, languages and topics."""
    return mixing.sample(docs, MIXTURE_SHARE)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("mixture", mixture), ("sequences", sequences)]

#: The stages fit models and draw samples by hashes, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
