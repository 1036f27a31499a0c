"""A training-data pipeline over `documents`, stage by stage.

Each stage takes what its predecessor kept, in full, and its decisions take effect: toxic
documents go, repeated lines go, one document of each near-duplicate group stays,
documents that hold a benchmark item go, and the rest is encoded. run() writes every
stage below spark.checkpoint.dir and reads it again as the next one's input, so a lost
executor costs no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import bpe, common, decontaminate, line_dedup, ngram_join, toxicity

TOKENIZER = "word_bpe_49k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.5 or more; the lexicon is learned from labels outside the held-out fifth."""
    labels = common.table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.learn(docs, toxicity.learnable(labels)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier line equals or is one word edit away from; a document that loses all its words goes."""
    return line_dedup.drop_lines(docs)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group that links of 0.8 or more on five-word shingles connect."""
    return ngram_join.keep_first(docs, k=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each document that is left."""
    import public_tokenizers

    spec = bpe.read_spec(public_tokenizers.path(TOKENIZER))
    return bpe.encode(docs, spec, bpe.build_lexicon(docs, spec))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_join", ngram_stage),
    ("decontamination", benchmark_stage),
    ("bpe", bpe_stage),
]

#: A learned lexicon and BPE are beyond SQL; tests/llm/test_brute.py holds every stage against brute force
#: over a table with planted cases, and the last against the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    work = common.shared_dir(spark)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"{work}/{name}")
    return docs
