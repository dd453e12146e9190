"""Texts as numbers: a word dictionary of the whole table and shards of encoded texts.

Words are numbered in two steps, so that a word is shuffled once a shard and not
once an occurrence. A task numbers the words of the texts it reads locally and
cuts a shard when it has seen ``words_per_shard`` of them; it writes each text
as its local numbers and, at the end of a shard, the shard's own word list with
counts. The word lists are summed to the global dictionary, which has one row
a word; joined back, it gives each shard the columns (number -> term) it needs,
and shard and columns meet by a cogroup whose groups are bounded by
``words_per_shard`` (a longer text makes a shard by itself).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedsight.llm.common import by_value, small_batches, stage_table

by_value(__name__)

WORDS_PER_SHARD = 2_000_000


def packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as bytes, all lowest bytes first, then all second ones: the high
    bytes of small numbers are long runs of zeros, which any codec removes."""
    x = np.ascontiguousarray(numbers, dtype=kind)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpacked(values: pa.ChunkedArray | pa.Array, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """Row pointer and all numbers of a column of packed numbers."""
    width, parts = np.dtype(kind).itemsize, []
    for v in values:
        x = np.frombuffer(v.as_py() or b"", dtype=np.uint8)
        parts.append(np.ascontiguousarray(x.reshape(width, -1).T).view(kind).ravel())
    pointer = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    return pointer, np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def encode(rows: DataFrame, text: str, keep: list[str], counted: Column | None = None, lower: bool = False, end: bool = False,
           words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """Staged table of two kinds of rows: a text's (shard, ``keep``, codes) with
    a null word, and a shard's word (shard, code, word, n) with null codes (see
    :func:`packed`).

    Words are runs of anything but ASCII white space (``lower``: A-Z in lower
    case); ``end`` adds the empty word after each text. n counts a word in the
    shard's texts for which ``counted`` is true (default: all). Null texts have
    no words. Rows keep their number.
    """
    body = rows.select(*keep, F.col(text).cast("binary").alias("text"), (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).alias("counted"))
    kept = T.StructType([T.StructField(c, body.schema[c].dataType) for c in keep])
    out = T.StructType([T.StructField("shard", T.LongType()), T.StructField("code", T.IntegerType()), T.StructField("word", T.BinaryType()),
                        T.StructField("n", T.LongType()), *kept.fields, T.StructField("codes", T.BinaryType())])
    first = [b""] if end else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        seen: dict[bytes, int] = {w: i for i, w in enumerate(first)}
        counts, total, kinds = np.zeros(0, dtype=np.int64), 0, None

        def words() -> pa.RecordBatch:
            n = np.zeros(len(seen), dtype=np.int64)
            n[:len(counts)] = counts
            cols = [pa.array(np.full(len(seen), (part << 24) + number)), pa.array(np.arange(len(seen), dtype=np.int32)),
                    pa.array(list(seen), pa.binary()), pa.array(n), *[pa.nulls(len(seen), k) for k in kinds], pa.nulls(len(seen), pa.binary())]
            return pa.RecordBatch.from_arrays(cols, out.names)

        for batch in batches:
            kinds = [batch.column(c).type for c in keep]
            at = 0
            while at < batch.num_rows:
                codes, adds, start = [], [], at
                while at < batch.num_rows and (at == start or total < words_per_shard):
                    t = batch.column("text")[at].as_py() or b""
                    ws = (t.lower() if lower else t).split()
                    own = np.fromiter((seen.setdefault(w, len(seen)) for w in ws), dtype=np.int32, count=len(ws))
                    if end:
                        own = np.append(own, np.int32(0))
                    codes.append(packed(own))
                    total += len(own)
                    if batch.column("counted")[at].as_py():
                        adds.append(own)
                    at += 1
                if adds:
                    more = np.bincount(np.concatenate(adds), minlength=len(seen))
                    more[:len(counts)] += counts
                    counts = more
                m = at - start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, (part << 24) + number)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()),
                     *[batch.column(c).slice(start, m) for c in keep], pa.array(codes, pa.binary())], out.names)
                if total >= words_per_shard:
                    yield words()
                    number += 1
                    seen, counts, total = {w: i for i, w in enumerate(first)}, np.zeros(0, dtype=np.int64), 0
        if total:
            yield words()

    small_batches()
    return stage_table(body.mapInArrow(run, out), "encoded")


def texts(encoded: DataFrame) -> DataFrame:
    """The encoded texts: shard, the kept columns and codes."""
    return encoded.where(F.col("word").isNull()).drop("code", "word", "n")


def words(encoded: DataFrame) -> DataFrame:
    """The shards' own words: shard, code, word, n."""
    return encoded.where(F.col("word").isNotNull()).select("shard", "code", "word", "n")


def dictionary(encoded: DataFrame) -> DataFrame:
    """Staged table of every word once: word, n (its counted occurrences) and
    term (its number in the whole table)."""
    return stage_table(words(encoded).groupBy("word").agg(F.sum("n").alias("n")).withColumn("term", F.monotonically_increasing_id()), "dictionary")


def translate(encoded: DataFrame, terms: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``fn`` of each shard's texts and of its columns: the rows of ``terms``
    (word and what is known of it) for its words, in the order of their codes."""
    columns = words(encoded).select(F.col("shard").alias("of"), "code", "word").join(terms, "word").drop("word")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right.sort_by("code"))

    return texts(encoded).groupBy("shard").cogroup(columns.groupBy("of")).applyInArrow(run, schema)

