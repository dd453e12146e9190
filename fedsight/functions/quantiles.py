"""Exact percentiles by selection.

Three passes over the values, none of which moves the table:

1. a sketch of each column (``percentile_approx``, small and mergeable) names two
   cut points around every wanted quantile;
2. each value's slot between its column's cut points is counted, in one
   aggregate with map-side sums. Values equal to a cut point have a slot of their
   own, so a value that most rows share is found here;
3. only the values of slots that hold a wanted rank, a few thousandths of a
   column for each quantile, are counted by value and shuffled. They are
   range-partitioned; counts per partition give offsets, a running sum inside
   the partition gives ranks, and two values a quantile come back.

The sketch decides how much is shuffled, never the result: a rank is looked for
in the slot that the exact counts put it in, whichever that is.

Interpolation follows ``percentile``: pos = p·(n-1), value =
(ceil(pos)-pos)·v[floor] + (pos-floor(pos))·v[ceil].
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedsight.session import cut_lineage

#: Ranks of the sketch are right within 1 / ACCURACY of a column; cut points lie MARGIN times that around a quantile.
ACCURACY, MARGIN = 1000, 2


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def _cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(c, v): the finite values of all columns, numbered in the order of ``cols``."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), _finite(c).alias("v")) for i, c in enumerate(cols)])
    return df.select(F.explode(cells).alias("x")).select("x.c", "x.v").where(F.col("v").isNotNull())


def _slotted(cells: DataFrame, bounds: dict[int, list[float]], width: int) -> DataFrame:
    """(c, v, slot): 2 i for a value after i of its column's bounds, one more if
    it is the next one. The bounds are one short row a column."""
    rows = [(c, *b, *[None] * (width - len(b))) for c, b in bounds.items()]
    table = cells.sparkSession.createDataFrame(rows, "c int, " + ", ".join(f"b{i} double" for i in range(width)))
    slot = F.lit(0)
    for i in range(width):
        slot = slot + F.when(F.col("v") > F.col(f"b{i}"), 2).when(F.col("v") == F.col(f"b{i}"), 1).otherwise(0)
    return cells.join(F.broadcast(table), "c").select("c", "v", slot.alias("slot"))


def _at_ranks(values: DataFrame, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """{(c, rank): value} of a table (c, v, n) of counted distinct values, for 0-based ranks."""
    spark = values.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = cut_lineage(values.repartitionByRange(parts, "c", "v").withColumn("p", F.spark_partition_id()))
    upto, starts = defaultdict(int), defaultdict(list)
    for c, p, n in sorted(t.groupBy("c", "p").agg(F.sum("n")).collect()):     # columns x partitions rows at most
        starts[c].append((upto[c], p))
        upto[c] += n
    lookups = []
    for c, rank in sorted(wanted):
        before, p = max(x for x in starts[c] if x[0] <= rank)
        lookups.append((c, p, rank, rank - before))
    look = F.broadcast(spark.createDataFrame(lookups, "c int, p int, rank long, inside long"))      # two rows a quantile
    running = F.sum("n").over(Window.partitionBy("c", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = t.join(F.broadcast(spark.createDataFrame(sorted({x[:2] for x in lookups}), "c int, p int")), ["c", "p"], "left_semi")
    hits = (near.withColumn("upto", running).join(look, ["c", "p"])
            .where((F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("n") <= F.col("inside"))))
    return {(r["c"], r["rank"]): r["v"] for r in hits.select("c", "rank", "v").collect()}


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> dict[tuple[str, float], float | None]:
    """Exact percentile (``percentile`` semantics) of the finite values of each
    column, for each probability: {(col, p): value or None}. ``accuracy`` sets
    the size of the sketches, and with it how many values are shuffled; the
    result does not depend on it."""
    out: dict[tuple[str, float], float | None] = {(c, p): None for c in cols for p in probs}
    if not out:
        return out
    cells = _cells(df, cols)
    cuts = sorted({min(1.0, max(0.0, p + side * MARGIN / accuracy)) for p in probs for side in (-1, 1)})
    sketch = cells.groupBy("c").agg(F.percentile_approx("v", cuts, accuracy).alias("b"))
    bounds = {r["c"]: sorted(set(r["b"])) for r in sketch.collect()}          # a row a column
    if not bounds:
        return out
    slotted = _slotted(cells, bounds, max(map(len, bounds.values())))
    counts = defaultdict(dict)
    for c, slot, n in slotted.groupBy("c", "slot").agg(F.count(F.lit(1))).collect():      # columns x slots rows
        counts[c][slot] = n
    want = {}                                                # (column, p) -> lower rank, upper rank, position
    found: dict[tuple[int, int], float] = {}                 # (column, rank) -> value
    inner: dict[tuple[int, int], int] = {}                   # (column, rank) -> slot that holds it
    skipped = {}                                             # (column, slot) -> values before it
    for c, slots in counts.items():
        total = sum(slots.values())
        for p in probs:
            pos = p * (total - 1)
            want[c, p] = (math.floor(pos), math.ceil(pos), pos)
        before = 0
        for slot in sorted(slots):
            skipped[c, slot] = before
            for rank in {r for p in probs for r in want[c, p][:2] if before <= r < before + slots[slot]}:
                if slot % 2:
                    found[c, rank] = bounds[c][slot // 2]
                else:
                    inner[c, rank] = slot
            before += slots[slot]
    if inner:
        need = sorted({(c, slot) for (c, _), slot in inner.items()})
        # Ranks count the values that are left: those of a column's needed slots, one slot after another.
        shift, left = {}, defaultdict(int)
        for c, slot in need:
            shift[c, slot] = skipped[c, slot] - left[c]
            left[c] += counts[c][slot]
        slots = F.broadcast(df.sparkSession.createDataFrame(need, "c int, slot int"))
        values = slotted.join(slots, ["c", "slot"], "left_semi").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        local = {(c, rank - shift[c, slot]): rank for (c, rank), slot in inner.items()}
        found.update({(c, local[c, r]): v for (c, r), v in _at_ranks(values, set(local)).items()})
    for (c, p), (lo, hi, pos) in want.items():
        a, b = found[c, lo], found[c, hi]
        out[cols[c], p] = a if lo == hi or a == b else (hi - pos) * a + (pos - lo) * b
    return out
