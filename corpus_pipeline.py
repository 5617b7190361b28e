"""Corpus pipeline: five stages over documents, each a DataFrame of what it keeps, written and read again before the next.

Counted as part of the subpackage skuforge.llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm import byte_bpe, common, decontaminate, ngram_join, pii, quality_fm

RANKS = "byte_bpe_50k.tiktoken"
ACCEPT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ACCEPT; the model learns from all labelled rows' sample."""
    model = quality_fm.train(docs, common.table(spark, sf_dir, "labels"))
    score = common.free_name(docs, "score")
    kept = quality_fm.scores(docs, model, score_col=score).filter(F.col(score) >= ACCEPT)
    return kept.select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items go from texts; documents that are mostly test items go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by their kind, disclosing terms generalised."""
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids and n_tokens."""
    return byte_bpe.encode(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: A trained model, link groups, an automaton and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    work = common.Workspace(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
