"""From raw documents to token ids: five stages, each on all that the stage before it kept.

Language identification predicts every document and drops those that have no letter (`und`); of each group of near
duplicates (five-word shingles, similarity 0.8) the one with the smallest doc_id stays; repeated passages are taken out of
the texts; documents that hold a benchmark passage go; what is left is encoded and, as a check, decoded.

Defined cases, stage by stage, stand in the docstrings. Rows without a doc_id pass all stages that they pass on their text alone, and keep
their text; no column of documents is needed but doc_id and text (and lang for what is learned), and other columns are kept under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import bpe, decontaminate, language, neardup, scratch, substring


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language isn't `und`; a null or wordless text goes, a null lang is filled in."""
    scratch.small_batches(spark)
    return language.accept(docs, language.learned(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; equal rows of a doc_id become one; rows without a doc_id stay."""
    return neardup.deduplicate(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occurred earlier; a text that loses all its words stays as an empty one."""
    return substring.clean(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; an empty benchmark leaves all."""
    return decontaminate.clean(docs, scratch.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document; a null text has no tokens."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminated),
    ("bpe", encode),
]

#: The language model and the tokenizer's merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written and read again, and a stage's own intermediate tables go once it is."""
    docs = scratch.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch.folder(spark, f"stage-{name}")
        with scratch.scope(spark, f"work-{name}"):
            docs = scratch.store(stage(spark, docs, sf_dir), path)
    return docs
