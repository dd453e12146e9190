"""Balanced shards by minimax contiguous partition.

Groups of equal texts are atomic. They are ordered by the digest of their text
(uniform, so order buckets are even whatever the ids look like) and cut into
``n_shards`` contiguous runs whose largest byte size is the smallest possible:
a search over the shard capacity halves (here: cuts into ``PROBES`` parts) the
range between a bound that cannot be beaten and one that always suffices, and a
greedy pass checks each capacity.

At scale the greedy check never sees the groups on the driver: prefix sums of
bytes stay in a table; a greedy step asks, for all capacities at once, for the
last group that still fits, which is one filtered aggregate over the order
buckets concerned. The driver holds ``PROBES`` numbers and one row per bucket.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedsight.llm.common import cut_lineage

PROBES = 64
GROUPS_PER_BUCKET = 50_000


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _prefix(key: Column) -> Column:
    """The first 32 bits of a digest as a number."""
    return F.conv(F.substring(F.hex(key), 1, 8), 16, 10).cast("long")


def _capacity(groups: DataFrame, ends: list[tuple[int, int]], n_shards: int, largest: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity and its cuts (byte positions of shard ends).

    ``ends``: (bucket, bytes up to its end) in order of the buckets that hold groups.
    """
    spark = groups.sparkSession
    total = ends[-1][1]
    tops = [e for _, e in ends]

    def cuts_of(caps: list[int]) -> list[list[int]]:
        at, cuts = [0] * len(caps), [[] for _ in caps]
        for _ in range(n_shards):
            want = [min(total, p + c) for p, c in zip(at, caps)]
            ask, found = [], {}
            for i, x in enumerate(want):
                j = bisect_left(tops, x)        # the first bucket that ends at x or later
                if tops[j] == x:
                    found[i] = x
                else:
                    found[i] = tops[j - 1] if j else 0
                    ask.append((i, ends[j][0], x))
            if ask:
                q = spark.createDataFrame(pa.table(dict(zip(("i", "bucket", "x"), map(list, zip(*ask))))))
                for i, got in (groups.join(F.broadcast(q), "bucket").where("end_bytes <= x")
                               .groupBy("i").agg(F.max("end_bytes")).collect()):
                    found[i] = got
            for i in range(len(caps)):
                at[i] = found[i]
                cuts[i].append(found[i])
            if all(p == total for p in at):
                break
        return [c if p == total else [] for c, p in zip(cuts, at)]

    lo = max(-(-total // n_shards), largest)
    hi = -(-total // n_shards) + largest    # always feasible: each shard but the last is filled beyond the mean
    best = None
    while lo <= hi:
        n = min(PROBES, hi - lo + 1)
        caps = sorted({lo + (hi - lo) * i // max(1, n - 1) for i in range(n)})
        got = cuts_of(caps)
        k = next((i for i, c in enumerate(got) if c), None)
        if k is None:       # all of a range whose next larger capacity is known to do
            break
        best, hi = (caps[k], got[k]), caps[k] - 1
        lo = caps[k - 1] + 1 if k else hi + 1
    return best


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    size: UTF-8 bytes of the text plus one (null text: 1). Rows of equal texts
    share a shard; null and empty texts count as equal. slot numbers a shard's
    rows from 0 without gaps, by text digest, then id (nulls first); which of
    several fully equal rows gets which of their slots is open. Shards may stay
    empty when there are fewer groups than shards; an empty table gives an
    empty result. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    utf8 = F.encode(text, "UTF-8")
    rows = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                                   F.crc32(utf8).alias("text_crc32"), _digest(utf8).alias("key")))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    n_groups, largest, most = sizes.agg(F.count(F.lit(1)), F.max("bytes"), F.max("n")).first()
    if not n_groups:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bits = min(24, max(6, math.ceil(math.log2(n_groups / GROUPS_PER_BUCKET + 1))))
    salts = 1 << math.ceil(math.log2(most) / 2)     # as many parts of the largest group as rows in a part
    sizes = sizes.withColumn("bucket", F.shiftright(_prefix(F.col("key")), 32 - bits))
    tops = sorted(sizes.groupBy("bucket").agg(F.sum("bytes"), F.sum("n")).collect())  # one row a bucket
    starts, ends, b0, r0 = [], [], 0, 0
    for bucket, b, n in tops:
        starts.append((bucket, b0, r0))
        b0, r0 = b0 + b, r0 + n
        ends.append((bucket, b0))
    off = F.broadcast(docs.sparkSession.createDataFrame(pa.table(dict(zip(("bucket", "b0", "r0"), map(list, zip(*starts)))))))
    w = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    groups = cut_lineage(sizes.join(off, "bucket").select(
        "bucket", "key", (F.col("b0") + F.sum("bytes").over(w)).alias("end_bytes"),
        (F.col("r0") + F.sum("n").over(w) - F.col("n")).alias("first_row")))
    _, cuts = _capacity(groups, ends, n_shards, largest)
    place = F.lit(0)
    for c in sorted(set(cuts[:-1])):
        place = place + F.when(F.col("end_bytes") > c, 1).otherwise(0)
    groups = groups.select("key", "first_row", place.cast("int").alias("shard"))
    base = {s: r for s, r in groups.groupBy("shard").agg(F.min("first_row")).collect()}  # one row a shard
    first = F.create_map(*[F.lit(x) for s, r in base.items() for x in (s, r)])[F.col("shard")]
    groups = groups.select("key", "shard", (F.col("first_row") - first).cast("long").alias("at"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))
    if salts > 1:   # a large group's rows are numbered part by part
        wk = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        parts = salted.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"))
        groups = parts.select("key", "salt", F.coalesce(F.sum("n").over(wk), F.lit(0)).alias("before")).join(groups, "key").select(
            "key", "salt", "shard", (F.col("at") + F.col("before")).alias("at"))
        keys = ["key", "salt"]
    else:
        keys = ["key"]
    wr = Window.partitionBy(*keys).orderBy("doc_id")
    return salted.join(groups, keys).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.row_number().over(wr) - 1).cast("long").alias("slot"))
