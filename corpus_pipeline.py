"""A training corpus from documents: rules, classifier, near-duplicates, mixing, tokens.

Each stage gets the rows that the one before kept, as a written table, and all but the last return
the columns of documents. Null texts fail the quality rules; extra columns pass through.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from posterwall.llm import byte_bpe, compression_rules, minhash_groups, rule_ensemble, source_mix
from posterwall.llm.registry import table
from posterwall.llm.store import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return compression_rules.keep_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of quality 1."""
    return rule_ensemble.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash_groups.keep_representatives(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row, and the digest of the text that the ids decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encoded_documents(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_dedup),
    ("source mix", mix_sources),
    ("byte BPE", encode),
]

# Compression ratios, trained models and random rounding are not SQL; the stages are tested against
# brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
