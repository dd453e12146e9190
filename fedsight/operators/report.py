"""Report tables — the data behind the reference's charts (K1-K6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedsight.functions.draws import uniform


def _top(df: DataFrame, part: Sequence[str], n: int | None, col: str = "value") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(F.desc(F.abs(col)), F.asc("feature"))
    d = df.withColumn("rank", F.row_number().over(w))
    return d.where(F.col("rank") <= n) if n is not None else d


# K1 / H8 -----------------------------------------------------------------------------
def topk_importance(df: DataFrame, k: int, part: Sequence[str] = ("client_id", "round", "method")) -> DataFrame:
    return _top(df, part, k)


def importance_report(glob: DataFrame, n: int = 10, part: Sequence[str] = ("round", "method")) -> DataFrame:
    return _top(glob, part, n).select(*part, "rank", "feature", "value",
                                      F.abs("value").alias("abs_value"),
                                      F.signum("value").cast("int").alias("sign"))


# K2 -------------------------------------------------------------------------------
def client_comparison(imp: DataFrame, n: int = 10, max_clients: int | None = None, seed: int = 42,
                      part: Sequence[str] = ("round", "method"), client: str = "client_id") -> DataFrame:
    """All clients, or ``max_clients`` hash-chosen ones per round/method; each client's top-n;
    the union of those features, or — when larger than n — the n features in
    most clients' lists (ties: name); grid zero-filled."""
    part = list(part)
    cl = imp.select(*part, client).distinct()
    if max_clients is not None:
        cl = cl.withColumn("_u", uniform(client, *part, seed=seed))
        cl = cl.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("_u", client))).where(
            F.col("_r") <= max_clients).select(*part, client)
    top = _top(imp.join(cl, [*part, client], "left_semi"), [*part, client], n)
    freq = top.groupBy(*part, "feature").agg(F.count(F.lit(1)).alias("_c"))
    keep = freq.withColumn("_k", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("_c"), "feature"))).where(
        F.col("_k") <= n).select(*part, "feature")
    grid = cl.join(keep, part)
    return grid.join(top.select(*part, client, "feature", "value"), [*part, client, "feature"], "left").select(
        *part, client, "feature", F.coalesce("value", F.lit(0.0)).alias("importance"))


# K3 -------------------------------------------------------------------------------
def importance_evolution(glob: DataFrame, k: int = 5, features: Sequence[str] | None = None,
                         part: Sequence[str] = ("method",)) -> DataFrame:
    """Given features, or the top-k of the latest round; every round, 0 when absent."""
    part = list(part)
    rounds = glob.select(*part, "round").distinct()
    if features is None:
        last = glob.groupBy(*part).agg(F.max("round").alias("round"))
        feats = _top(glob.join(last, [*part, "round"], "left_semi"), part, k).select(*part, "feature")
    else:
        feats = glob.select(*part).distinct().withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    grid = rounds.join(feats, part)
    return grid.join(glob.select(*part, "round", "feature", "value"), [*part, "round", "feature"], "left").select(
        *part, "round", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))


# K4 -------------------------------------------------------------------------------
def round_statistics(glob: DataFrame, part: Sequence[str] = ("round", "method"), digits: int = 6) -> DataFrame:
    return glob.groupBy(*part).agg(
        F.count(F.lit(1)).alias("feature_count"), F.count_if(F.col("value") != 0).alias("nonzero_count"),
        F.round(F.avg("value"), digits).alias("mean_value"), F.round(F.max("value"), digits).alias("max_value"),
        F.round(F.min("value"), digits).alias("min_value"))


# K5 -------------------------------------------------------------------------------
def dashboard_summary(glob: DataFrame) -> DataFrame:
    return glob.agg(F.count_distinct("round").alias("n_rounds"), F.max("round").alias("latest_round"),
                    F.array_sort(F.collect_set("method")).alias("methods"))
