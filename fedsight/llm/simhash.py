"""SimHash near-duplicate groups by multi-index hashing.

A text's fingerprint has 64 bits; bit i is set when over half of its shingle
hashes have it set. Two texts are linked when their fingerprints differ in few
bits. Every fingerprint is cut into segments; two fingerprints within d bits
agree up to floor(d / segments) bits in one segment at least, so a probe table
holds every value of the small Hamming ball around each segment and meets the
index table of plain segments in an equi-join. The whole distance is verified
in the join condition, so only true links leave the join. The fingerprint
column is the only thing shuffled, and only distinct fingerprints are: a group
of exact copies, however large, is one row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import by_value, cut_lineage, small_batches
from fedsight.llm.components import connected_components

BITS = 64
#: Shingle hashes unpacked to bits at a time, which bounds a task's memory.
BLOCK = 1 << 16

by_value(__name__)


def simhash(text: str | None, k: int = 3) -> int:
    """Fingerprint of one text as a signed 64-bit integer; see :func:`fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        grams, n = iter([words]), 1
    else:
        grams, n = zip(*(words[i:] for i in range(k))), len(words) - k + 1
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, BLOCK):
        m = min(BLOCK, n - start)
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), 42) for g, _ in zip(grams, range(m))), dtype=np.uint64, count=m)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(m, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprint(text: Column, k: int = 3) -> Column:
    """Column of fingerprints. A-Z are lower-cased, words are runs of anything
    but ASCII white space, shingles are ``k`` words joined by a space, repeats
    count. Fewer than ``k`` words: the whole sequence is the one shingle; no
    word (null, empty or blank text): fingerprint zero."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, k) for t in texts], dtype="int64")
    small_batches()
    return fp(text)


def hamming_links(fps: DataFrame, fp: str = "fp", max_bits: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in ``max_bits`` bits at most."""
    width, radius = BITS // segments, max_bits // segments
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    index = None
    base = fps.select(F.col(fp).alias("fp")).where(F.col("fp").isNotNull()).distinct()
    for s in range(segments):
        part = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1))
        one = base.select(F.lit(s).alias("seg"), part.alias("val"), "fp")
        index = one if index is None else index.unionByName(one)
    # Of two segments within the ball, the smaller value probes for the larger.
    probe = (index.select("seg", "fp", F.col("val").alias("own"), F.explode(F.lit(masks).cast("array<bigint>")).alias("mask"))
             .select("seg", F.col("fp").alias("a"), "own", F.col("own").bitwiseXOR(F.col("mask")).alias("val"))
             .where("val >= own"))
    hits = probe.join(index.withColumnRenamed("fp", "b"), ["seg", "val"])
    return hits.where((F.expr("own < val") | (F.col("a") < F.col("b")))
                      & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                    max_bits: int = 3, segments: int = 2) -> DataFrame:
    """doc_id, fp (signed 64-bit fingerprint) and component_id of every row.

    ``component_id`` is the smallest id reachable over links of ``max_bits``
    differing bits at most, the row's own included. Rows keep their number:
    repeated rows and ids stay repeated and share a component. A null id takes
    part in links but never names a component (a component of null ids only has
    a null component_id). Null and empty texts have fingerprint zero and are
    linked like any other. Other columns of ``docs`` are not read.
    """
    return _grouped(docs, id_col, text_col, k, max_bits, segments).drop("root")


def _grouped(docs: DataFrame, id_col: str, text_col: str, k: int, max_bits: int, segments: int = 2) -> DataFrame:
    """:func:`near_duplicates` with root: one fingerprint of the component, which
    tells components apart that share a name because ids are repeated."""
    fps = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), k).alias("fp")))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = connected_components(hamming_links(least, "fp", max_bits, segments))
    rooted = least.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 3) -> DataFrame:
    """Rows of ``docs`` without near copies: of each group one row of the smallest
    id stays. An id may be repeated: rows of one id with texts that are no near
    copies belong to groups of their own, and each group keeps its row; rows of
    one id in one group are told by fingerprint, the smallest stays, once. Rows
    without an id cannot be named by a group and stay as they are."""
    groups = cut_lineage(_grouped(docs, id_col, text_col, k, max_bits).where(F.col("doc_id").isNotNull()))
    keep = groups.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("x")).select("x.doc_id", "x.fp")
    twice = cut_lineage(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    once = keep.join(twice, "doc_id", "left_anti").select(F.col("doc_id").alias(id_col))
    out = docs.join(once, id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    if twice.isEmpty():
        return out
    # Fingerprints of the rows with a repeated id only.
    rows = docs.join(twice.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    named = rows.withColumn("__fp", fingerprint(F.col(text_col), k))
    kept = named.join(keep.select(F.col("doc_id").alias(id_col), F.col("fp").alias("__fp")), [id_col, "__fp"], "left_semi")
    return out.unionByName(kept.dropDuplicates([id_col, "__fp"]).select(docs.columns))
