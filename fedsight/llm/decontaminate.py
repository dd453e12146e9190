"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is short and a document may be long, so the search is for
containment, not resemblance. Items are partitioned by their number of
distinct shingles; an item's sketch is its ``k`` smallest shingle hashes, with
``k = q - ceil(t q) + 1`` for its size q. Shingles that fewer items hold count
as smaller, so a passage that very many items share stands for an item only if
the item has too few others; any order keeps what follows. A document that holds the share t of
the item's shingles misses ``q - ceil(t q)`` of them at most, so it holds one
of the sketch at least: the search has no misses. Documents are partitioned by
size, too: an item is looked up only in documents that have enough shingles for
it. Candidates are verified by exact shingle containment on the words.

Only built-in expressions run. A document's shingles never leave their row
before the sketch lookup; what is shuffled are candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import broadcast_checked, cut_lineage, letter_words

#: Sketch rows up to which the lookup table is broadcast (16 bytes a row).
MAX_BROADCAST_ROWS = 2_000_000


def _grams(df: DataFrame, k: int, *keep: str) -> DataFrame:
    """A row for each position of a shingle in the word array ``w`` (0-based
    ``i``). The outer form keeps the optimiser from copying the word split into
    a filter below it."""
    at = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0))))
    return df.select(*keep, "w", F.explode_outer(at).alias("i")).where(F.col("i").isNotNull())


def _hash(k: int) -> Column:
    return F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(k)])


def _text(k: int) -> Column:
    return F.expr(f"array_join(slice(w, i + 1, {k}), ' ')")


def item_shingles(items: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """item_id, gram, h (its hash) and q (their number): the distinct shingles of
    each item (fewer than ``k`` words: the whole sequence; no word: no row)."""
    words = items.select(F.col(id_col).alias("item_id"), letter_words(F.col(text_col)).alias("w"))
    grams = _grams(words, k, "item_id").select("item_id", _text(k).alias("gram"), _hash(k).alias("h")).distinct()
    return grams.join(grams.groupBy("item_id").agg(F.count(F.lit(1)).alias("q")), "item_id")


def _need(threshold: float) -> Column:
    """How many of an item's q shingles a document must hold."""
    return F.ceil(F.col("q") * F.lit(float(threshold)) - F.lit(1e-9)).cast("int")


def item_sketches(grams: DataFrame, threshold: float) -> DataFrame:
    """item_id, need and h: the hashes that stand for each item of :func:`item_shingles`."""
    need = _need(threshold)
    ranked = grams.join(grams.groupBy("h").agg(F.count(F.lit(1)).alias("held_by")), "h")
    return (ranked.groupBy("item_id", "q").agg(F.sort_array(F.collect_list(F.struct("held_by", "h"))).alias("s"))
            .select("item_id", need.alias("need"), F.explode(F.slice("s.h", F.lit(1), (F.col("q") - need + 1).cast("int"))).alias("h")))


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
                 text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared and containment of every
    document and test item with containment of ``threshold`` or more.

    Texts are lower-cased; words are runs of letters and digits. Null and empty
    texts, and items without a word, match nothing. Null ids match nothing.
    Rows that repeat an id with other words are looked up one by one, and the
    largest containment counts; equal rows are one. Rows of ``items`` that share
    an id are one item with the shingles of all. Ties and repeated items are all
    returned, each under its own id. Empty tables give an empty result. Other
    columns are not read.
    """
    grams = item_shingles(items.where(F.col(item_id).isNotNull()), item_id, item_text, k)
    need = _need(threshold)
    sketch = item_sketches(grams, threshold)
    # One row a hash: the items it stands for and the size that the smallest of them asks of a document.
    lookup = sketch.groupBy("h").agg(F.min("need").alias("least"), F.collect_list(F.struct("need", "item_id")).alias("of"))
    rows = grams.count()
    words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), letter_words(F.col(text_col)).alias("w"))
    size = F.greatest(F.size("w") - (k - 1), F.lit(1))
    hashed = _grams(words, k, "doc_id").select("doc_id", size.alias("x"), _hash(k).alias("h"))
    found = (hashed.join(broadcast_checked(lookup, rows, MAX_BROADCAST_ROWS), "h").where("x >= least")
             .select("doc_id", "x", F.explode("of").alias("o")).where("x >= o.need")
             .select("doc_id", F.col("o.item_id").alias("item_id")).distinct())
    found = cut_lineage(found)
    # Verification on the words of candidate documents only, each shingle as text.
    cand = broadcast_checked(found.select("doc_id").distinct(), found.count(), MAX_BROADCAST_ROWS)
    again = words.join(cand, "doc_id", "left_semi").withColumn("row", F.xxhash64("w"))
    shared = (_grams(again, k, "doc_id", "row").select("doc_id", "row", _text(k).alias("gram"))
              .join(broadcast_checked(grams.select("gram", "item_id", "q"), rows, MAX_BROADCAST_ROWS // 10), "gram").distinct()
              .groupBy("doc_id", "row", "item_id", "q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need))
    return (shared.join(found, ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id", "q").agg(F.max("n").alias("n"))
            .select("doc_id", "item_id", F.col("q").alias("n_item_shingles"), F.col("n").alias("n_shared"),
                    (F.col("n") / F.col("q")).alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose document holds no test item (rows without an id
    stay: nothing is looked up for them)."""
    bad = cut_lineage(contaminated(docs, items, k, threshold, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(broadcast_checked(bad, bad.count(), MAX_BROADCAST_ROWS), id_col, "left_anti").select(docs.columns)
