"""From raw documents to packed training sequences, in five stages.

Each stage takes all documents that its predecessor kept and returns documents
again, but for the last, which returns the pieces of the packed sequences.

Defined results: a null text is scored as the empty one; texts without words are linked
with nothing; of rows that repeat (id and text) one stays, so does one document of each
group of near-duplicates, the one with the smallest id (null ids last); null texts stay
null; the mix takes documents as often as their source's share asks for, so that rows may
repeat from there on; a null text is packed as one separator; an empty table gives an
empty one; columns besides those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import mixing, neardup, packing, pii, quality
from attestra.llm.common import keep, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.deduplicated(docs, words=5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return pii.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled within shards."""
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: The classifier, the tokenizer and the packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
