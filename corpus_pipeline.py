"""Corpus cleaning pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``:

1. toxicity - documents that the toxicity operator rejects go;
2. language - documents whose language is not told go;
3. near_dedup - one document of each SimHash group stays;
4. decontaminate - documents that hold a benchmark item go;
5. encode - pieces of the documents that are left (doc_id, ids, n_pieces, same).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fedsight.llm import decontaminate, langid, pieces, simhash, toxicity
from fedsight.llm.common import stage_table
from fedsight.llm.queries import language_model, toxicity_lexicon
from fedsight.sources.tables import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 by the lexicon of the labelled documents."""
    return toxicity.clean(docs, toxicity_lexicon(spark, sf_dir), 0.7)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of 0.5 or more."""
    return langid.known(docs, language_model(docs), 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of fingerprints linked at 3 bits."""
    return simhash.deduplicate(docs, k=3, max_bits=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's 5-word shingles."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"), 5, 0.8)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    return pieces.encode_documents(docs, pieces.Codec(spark))


STAGES = [("toxicity", drop_toxic), ("language", known_language), ("near_dedup", near_dedup), ("decontaminate", drop_leaks),
          ("encode", encode)]

#: SQL expresses neither the fitted models nor the fingerprints and pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
