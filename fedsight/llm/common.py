"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsight.session import cut_lineage, ensure_checkpoint_dir

#: ASCII white space as the body of a character class.
WHITE_CLASS = r"\x20\x09-\x0D"


def by_value(module_name: str) -> None:
    """Ship a module's functions inside the task closure, so that executors
    need not have this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def white_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WHITE_CLASS}]+"), "")


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (null text: empty array)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: remainder 0)."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % modulus, F.lit(0))


def small_batches(rows: int = 1000) -> None:
    """Send texts to Python in batches of ``rows`` at most, so that a worker's
    memory does not depend on how long texts are times ten thousand. The
    session's setting is lowered, never raised."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back:
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint when the counted rows stay under the bound; else the
    planner's shuffle join."""
    return F.broadcast(df) if rows <= max_rows else df


__all__ = ["WHITE_CLASS", "SparkSession", "broadcast_checked", "by_value", "cut_lineage",
           "fold", "letter_words", "small_batches", "stage_table", "white_words"]
