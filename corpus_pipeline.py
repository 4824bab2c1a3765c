"""Corpus pipeline: toxicity, exact dedup, near dedup, decontamination, tokenisation.

Each stage reads the table that the stage before wrote, so a lost executor
costs at most the stage that runs.  SQL cannot express the toxicity votes,
fingerprint components or token ids, so ORACLE_SQL is None and the tests hold
run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alignspark.llm import common, decontaminate, exact_dedup, queries, sentencepiece_codec, simhash, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go."""
    return toxicity.clean_rows(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.distinct_rows(docs, keep="largest")


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean_rows(docs, common.table(spark, sf_dir, "benchmark"))


def _tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded text."""
    return sentencepiece_codec.encode_decode(docs, queries.tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("near_dedup", _near_dedup),
    ("decontaminate", _decontaminate),
    ("sentencepiece", _tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
