"""Sampling, splitting and client partitioning (E1-E9) as exact, deterministic,
distributed plans.

Random choices are hash draws (functions/draws.py) so every retry and every
engine makes the same choice. Quotas are computed from per-group counts (small
tables); rows are selected by their exact rank within the group, which comes
from bucket or range offsets (functions/rank.py) — no single-task window, no collect
of a group, no row cap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedsight.functions.draws import py_uniform, uniform
from fedsight.functions.rank import ordered_index, ranked, top_k_per_group


def _draw(df: DataFrame, keys: Sequence[str], seed, name: str = "_u") -> DataFrame:
    return df.withColumn(name, uniform(*keys, seed=seed))


def class_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_class"))


# E1 ---------------------------------------------------------------------------
def stratified_subsample(df: DataFrame, label: str, fraction: float, keys: Sequence[str],
                         seed: int = 42, buckets: int | None = None) -> DataFrame:
    """Exactly round(fraction * n_c) rows of every class c (half-up rounding)."""
    d = _draw(df, keys, seed)
    r = ranked(d, "_u", [label], tiebreak=list(keys), buckets=buckets, rank_col="_r", size_col="_n")
    return r.where(F.col("_r") <= F.round(F.col("_n") * F.lit(float(fraction)))).drop("_u", "_r", "_n")


# E2 ---------------------------------------------------------------------------
def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test_fraction: float = 0.2,
                     seed: int = 42, buckets: int | None = None, split_col: str = "split") -> DataFrame:
    """Add ``split`` in {'train','test'}: test size ceil(test_fraction * n),
    allocated to classes by largest remainder (ties: smaller label first)."""
    counts = class_counts(df, label)
    w_all = Window.partitionBy()  # over the per-class count table: a handful of rows
    c = (counts.withColumn("_n", F.sum("n_class").over(w_all))
         .withColumn("_nt", F.ceil(F.col("_n") * F.lit(float(test_fraction))))
         .withColumn("_exact", F.col("n_class") * F.col("_nt") / F.col("_n"))
         .withColumn("_fl", F.floor("_exact"))
         .withColumn("_left", F.col("_nt") - F.sum("_fl").over(w_all))
         .withColumn("_pos", F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("_fl")), F.asc(label))))
         .select(label, (F.col("_fl") + F.when(F.col("_pos") <= F.col("_left"), 1).otherwise(0)).alias("_quota")))
    d = _draw(df, keys, seed)
    r = ranked(d, "_u", [label], tiebreak=list(keys), buckets=buckets, rank_col="_r")
    r = r.join(F.broadcast(c), label, "left")  # one row per class
    return (r.withColumn(split_col, F.when(F.col("_r") <= F.col("_quota"), F.lit("test")).otherwise(F.lit("train")))
            .drop("_u", "_r", "_quota"))


# E3 / I3 -------------------------------------------------------------------------
def explanation_sample(df: DataFrame, client: str, label: str, keys: Sequence[str],
                       per_client: int = 10, min_samples: int | None = None,
                       privacy: bool = False, seed: int = 42) -> DataFrame:
    """Per client: k = min(per_client, n); pos = int(k * n_pos / n), neg = k - pos,
    each capped by availability; nothing when privacy is on and k < min_samples."""
    counts = df.groupBy(client).agg(F.count(F.lit(1)).alias("_n"),
                                    F.sum(F.col(label).cast("long")).alias("_np"))
    k = F.least(F.lit(per_client), F.col("_n"))
    pos = F.floor(k * F.col("_np") / F.col("_n"))
    q = counts.select(client, k.alias("_k"),
                      F.least(pos, F.col("_np")).alias("_qpos"),
                      F.least(k - pos, F.col("_n") - F.col("_np")).alias("_qneg"))
    if privacy and min_samples is not None:
        q = q.where(F.col("_k") >= F.lit(min_samples))
    # at most per_client rows a class and client are left when the quotas (one row per client) are joined
    d = top_k_per_group(_draw(df, [client, *keys], seed), [client, label], "_u", keys, per_client)
    quota = F.when(F.col(label) == 1, F.col("_qpos")).otherwise(F.col("_qneg"))
    return d.join(q, client, "inner").where(F.col("_r") <= quota).select(*df.columns)


# E4 ---------------------------------------------------------------------------
def balanced_sample(df: DataFrame, label: str, keys: Sequence[str], n_samples: int,
                    seed: int = 42) -> DataFrame:
    """min(n_samples // 2, n_pos, n_neg) rows from each class."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("np"), F.count_if(F.col(label) == 0).alias("nn"))
    m = counts.select(F.least(F.lit(n_samples // 2), F.col("np"), F.col("nn")).alias("m")).scalar()
    d = _draw(df, keys, seed).where(F.col(label).isin(0, 1))
    return top_k_per_group(d, [label], "_u", keys, n_samples // 2, m).drop("_u", "_r")


# E5 ---------------------------------------------------------------------------
def client_shares(num_clients: int, seed: int = 42, uniform_shares: bool = False) -> list[float]:
    """Dirichlet(1,...,1) shares from hash draws (normalised Exp(1) variables)."""
    if uniform_shares:
        return [1.0 / num_clients] * num_clients
    g = [-math.log(py_uniform([i + 1, "share"], seed)) for i in range(num_clients)]
    s = sum(g)
    return [x / s for x in g]


def partition_clients(df: DataFrame, order_cols: Sequence[str], num_clients: int = 3,
                      shares: Sequence[float] | None = None, seed: int = 42,
                      client_col: str = "client_id", prefix: str = "client_") -> DataFrame:
    """Contiguous slices of the rows in ``order_cols`` order: client i takes
    positions [start_i, start_i + int(n * p_i)); the last client takes the rest.
    Keys of any type, nulls first; the source is read once."""
    p = list(shares) if shares is not None else client_shares(num_clients, seed)
    r = ordered_index(df, order_cols, "_r", size_col="_n")
    n = F.col("_n")
    end = F.lit(0).cast("long")
    expr = None
    for i, share in enumerate(p[:-1]):
        end = end + F.floor(n * F.lit(float(share))).cast("long")
        cond = F.col("_r") < end
        expr = F.when(cond, F.lit(f"{prefix}{i + 1}")) if expr is None else expr.when(cond, F.lit(f"{prefix}{i + 1}"))
    last = F.lit(f"{prefix}{len(p)}")
    expr = last if expr is None else expr.otherwise(last)
    return r.withColumn(client_col, expr).drop("_r", "_n")


# E6 ---------------------------------------------------------------------------
def select_clients(client_rounds: DataFrame, client: str = "client_id", round_col: str = "round",
                   fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Per round: max(1, int(n_clients * fraction)) clients without replacement."""
    d = client_rounds.select(client, round_col).distinct().withColumn("_u", uniform(client, round_col, seed=seed))
    w = Window.partitionBy(round_col)
    d = d.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_r", F.row_number().over(Window.partitionBy(round_col).orderBy("_u", client)))
    m = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(fraction))))
    return d.where(F.col("_r") <= m).select(round_col, client)


# E7 ---------------------------------------------------------------------------
def overlapping_clients(df: DataFrame, keys: Sequence[str], num_clients: int, per_client: int,
                        seed: int = 42, prefix: str = "client_") -> DataFrame:
    """Each client draws ``per_client`` rows without replacement; a row may go to
    several clients. Only the rows that can be among a client's first are
    ranked, so a client's draws never sit in one task."""
    clients = F.array(*[F.lit(f"{prefix}{i + 1}") for i in range(num_clients)])
    d = df.withColumn("client_id", F.explode(clients))
    d = d.withColumn("_u", uniform("client_id", *keys, seed=seed))
    return top_k_per_group(d, ["client_id"], "_u", keys, per_client).drop("_u", "_r")


# E8 ---------------------------------------------------------------------------
def background_sample(df: DataFrame, keys: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """min(k, n) rows; a per-partition top-k then a k-row merge (TakeOrdered)."""
    d = _draw(df, keys, seed)
    return d.orderBy("_u", *keys).limit(k).drop("_u")


# E9 ---------------------------------------------------------------------------
def validation_holdout(df: DataFrame, order_cols: Sequence[str], fraction: float = 0.2,
                       col: str = "is_validation") -> DataFrame:
    """The last ``fraction`` of rows (in ``order_cols`` order, nulls first) are
    validation: position >= int(n * (1 - fraction)). The source is read once."""
    r = ordered_index(df, order_cols, "_r", size_col="_n")
    split_at = F.floor(F.col("_n") * F.lit(1.0 - float(fraction)))
    return r.withColumn(col, F.col("_r") >= split_at).drop("_r", "_n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """balanced weights n / (k * n_c) per class."""
    c = class_counts(df, label)
    w = Window.partitionBy()
    return (c.withColumn("_n", F.sum("n_class").over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
            .select(label, "n_class", (F.col("_n") / (F.col("_k") * F.col("n_class"))).alias("weight")))


def with_class_weight(df: DataFrame, label: str, col: str = "class_weight") -> DataFrame:
    cw = class_weights(df, label).select(label, F.col("weight").alias(col))
    return df.join(F.broadcast(cw), label, "left")  # one row per class
