"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 40)))).first()
    return tuple(r)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Node and root (smallest node reachable) of every node that has a link.

    Large-star and small-star steps alternate until the star forest stops
    changing (O(log^2 n) rounds). A node's smallest neighbour comes from a
    partially aggregated group-by, and the join back is a shuffle join whose
    hot keys adaptive execution splits, so a hub is never held in one task.
    Every round is checkpointed in the shared folder.

    An empty link table gives an empty result; loops (a = b), repeated links and
    links with a null end are ignored.
    """
    e = (links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    e = cut_lineage(e.where("u != v").distinct())
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))))
        e = cut_lineage(small.distinct())
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
