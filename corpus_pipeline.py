"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, word pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchlytics.llm import jaccard_join, mixing, pii, quality, sentence_pieces
from matchlytics.llm.common import kept_table, table
from matchlytics.llm.queries import MODEL, PII_KEY

#: Words per block of the mix: long enough to keep sentences together.
BLOCK = 256


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with cutoffs from the labelled holdout."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by similarity."""
    return jaccard_join.one_of_each(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pii.with_surrogates(docs, key=PII_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights; a document comes once for each epoch that takes words of it."""
    return mixing.Mix(docs, block=BLOCK).texts()


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the word pieces of each text of the mix, and whether decoding them gives the text back."""
    return sentence_pieces.encode(docs.select("doc_id", "source", "lang", "text"), MODEL, drop_text=True, round_trip="round_trip")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("surrogates", surrogates), ("mix", mix), ("pieces", pieces)]

#: Similarity components, keyed surrogates and pseudorandom mixing have no SQL form; the tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
