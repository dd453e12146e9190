"""Exact ranks and running sums without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task, and a
window partitioned by a hot group moves that whole group into one task. Two
ways, each the same for every input size:

* By a hash draw in (0, 1) (:func:`ranked`): bucket = floor(u·B), where B grows
  with the largest group (about ``rows_per_bucket`` rows per bucket). Rows are
  counted per (group, bucket) — a small table — whose running sums give each
  bucket's offset; inside a (group, bucket) the rank is a partitioned
  ``row_number``. A group holding a third of all rows is spread over all of its
  buckets, so no task sees a whole group.
* By any columns (:func:`ordered_index`, :func:`ordered_totals`): one range
  partitioning on all order columns, checkpointed; a row's position is its
  partition's offset plus its place in it. A value of the first column that
  most rows share is spread by the columns after it.

Top-k per group by a hash draw does not rank a whole group either: rows whose
draw is above a threshold, chosen from the group's size so that k rows are
below it, go before the window (see :func:`top_k_per_group`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 200_000
MIN_BUCKETS = 64
MAX_BROADCAST_GROUPS = 1_000_000   # rows of two numbers and the keys


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def auto_buckets(df: DataFrame, group_cols: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Bucket count for uniform keys from the largest group's size (one count job)."""
    g = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n")) if group_cols else df.agg(F.count(F.lit(1)).alias("n"))
    mx = g.agg(F.max("n")).first()[0] or 0
    b = max(MIN_BUCKETS, math.ceil(mx / rows_per_bucket))
    return 1 << (b - 1).bit_length()


def uniform_bucket(col: Column, buckets: int) -> Column:
    return F.least(F.floor(col * F.lit(float(buckets))).cast("int"), F.lit(buckets - 1))


def ranked(df: DataFrame, order_col: str, group_cols: Sequence[str] = (), tiebreak: Sequence[str] = (),
           buckets: int | None = None, rank_col: str = "rank",
           size_col: str | None = None) -> DataFrame:
    """Add an exact 1-based ``rank_col`` (row_number semantics) of every row
    within ``group_cols`` ordered by ascending ``order_col`` — a hash draw in
    (0, 1) — then ``tiebreak``; optionally the group size as ``size_col``."""
    g = list(group_cols)
    d = df.withColumn("_bk", uniform_bucket(F.col(order_col), buckets or auto_buckets(df, g)))
    counts = d.groupBy(*g, "_bk").agg(F.count(F.lit(1)).alias("_bn"))
    running = Window.partitionBy(*g).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_bn").over(running), F.lit(0)))
    if size_col:
        offsets = offsets.withColumn(size_col, F.sum("_bn").over(Window.partitionBy(*g)))
    offsets = offsets.drop("_bn")
    within = Window.partitionBy(*g, "_bk").orderBy(F.col(order_col).asc(), *[F.col(c).asc() for c in tiebreak])
    d = d.withColumn("_rn", F.row_number().over(within))
    out = d.join(offsets, [*g, "_bk"], "inner")
    return out.withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("long")).drop("_bk", "_off", "_rn")


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], draw: str, tiebreak: Sequence[str], k: int,
                    quota: Column | None = None, rank_col: str = "_r") -> DataFrame:
    """Rows with row_number() <= k in each group, ordered by a uniform hash draw
    in (0, 1) and ``tiebreak``, optionally also <= a per-group ``quota`` column.

    A group of n rows has about n·u rows with a draw below u, so only rows below
    u = (k + 8·sqrt(k) + 64) / n can be among the first k; they alone are ranked.
    That fewer than k rows are below it is a deviation of eight sigma; it is
    counted, and such a group is ranked whole.
    """
    from fedsight.session import cut_lineage
    keys = list(group_cols)
    cut = F.lit(float(k + 8 * math.sqrt(k) + 64)) / F.col("_gn")
    sizes = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gn")).withColumn("_cut", cut))
    small = sizes.count() <= MAX_BROADCAST_GROUPS
    rows = cut_lineage(df.join(F.broadcast(sizes) if small else sizes, keys).where(F.col(draw) <= F.col("_cut")).select(*df.columns))
    have = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gk"))
    short = sizes.join(have, keys, "left").where(F.coalesce("_gk", F.lit(0)) < F.least(F.lit(k), F.col("_gn"))).select(*keys)
    if not short.isEmpty():
        rows = rows.join(short, keys, "left_anti").unionByName(df.join(short, keys, "left_semi"))
    w = Window.partitionBy(*group_cols).orderBy(draw, *_cols(tiebreak))
    cond = F.col(rank_col) <= F.lit(int(k))
    if quota is not None:
        cond = cond & (F.col(rank_col) <= quota)
    return rows.withColumn(rank_col, F.row_number().over(w)).where(cond)


def ordered_index(df: DataFrame, order_cols: Sequence[str], index_col: str = "index",
                  partitions: int | None = None, size_col: str | None = None) -> DataFrame:
    """0-based position of every row in ascending ``order_cols`` order (nulls
    first; rows should be unique on ``order_cols``, the order of equal ones is
    fixed but arbitrary); optionally the number of rows as ``size_col``.

    Range partitioning (sampled bounds) spreads the rows; after sorting within
    partitions each row's position is its partition's offset (from per-partition
    counts, a table with one row per partition) plus its place in the partition.
    The partitioned, sorted data is checkpointed first so that partition ids and
    positions are fixed for both uses (and survive executor loss).
    """
    from fedsight.session import cut_lineage
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    p = cut_lineage(p.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    counts = p.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_p0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = counts.withColumn("_off", F.coalesce(F.sum("_rows").over(w), F.lit(0)))
    if size_col:
        offs = offs.withColumn(size_col, F.sum("_rows").over(Window.partitionBy()))
    out = p.join(F.broadcast(offs.drop("_rows")), "_pid")
    return out.withColumn(index_col, (F.col("_off") + F.col("_pos") - F.col("_p0")).cast("long")).drop(
        "_pid", "_pos", "_off", "_p0")


def ordered_totals(df: DataFrame, order_cols: Sequence[str], value: str, group_cols: Sequence[str] = (),
                   partitions: int | None = None, prefix: str = "before_") -> DataFrame:
    """For each row add ``before_<value>`` = the sum of ``value`` over the rows of
    its group that come earlier in ``order_cols`` order (which begins with the
    group columns; rows must be unique on it, nulls come first).

    One range partitioning spreads the rows, whatever the values are and however
    large a group is; it is checkpointed, so the source is read once. A row's
    total is that of its group's rows in earlier partitions, a table of one row
    for each partition and group in it, plus a running sum in its partition.
    """
    from fedsight.session import cut_lineage
    g = list(group_cols)
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p = cut_lineage(df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id()))
    sums = p.groupBy(*g, "_pid").agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)      # a row a partition
    offs = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_pid").alias("_p"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*g, "_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    rows = p.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_pid") == F.col("_p")
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = rows.join(offs, same)
    return out.select(*df.columns, (F.col("_i") + F.col("_o")).alias(f"{prefix}{value}"))
