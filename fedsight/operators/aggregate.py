"""Cross-client and cross-round aggregation of feature importances.

Input is the long ``importance`` table (client_id, round, method, feature,
value). Every statistic is a grouped aggregate or a window partitioned by
(round, method, feature) — a key with many values, so work spreads evenly.
Client pairs are built by an equi-join on (round, method[, feature]) with the
``a < b`` condition riding on it; their number is clients² per round by the
definition of pairwise agreement, never rows².
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedsight.functions.constants import RBO_P, TEMPORAL_DECAY, TRIM_FRACTION, ZSCORE_THRESHOLD
from fedsight.session import cut_lineage

KEYS = ["round", "method", "feature"]


# C5 -------------------------------------------------------------------------------
def client_pairs(imp: DataFrame, by: Sequence[str] = ("round", "method"), client: str = "client_id",
                 max_clients: int = 5_000) -> DataFrame:
    """Unordered pairs of the clients of each group. Their number is clients² by
    definition, so more than ``max_clients`` clients in a group are refused."""
    c = cut_lineage(imp.select(*by, client).distinct())
    most = c.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > max_clients:
        raise ValueError(f"{most} clients in a group make {most * (most - 1) // 2} pairs; max_clients is {max_clients}")
    a = c.withColumnRenamed(client, "client_a")
    b = c.withColumnRenamed(client, "client_b")
    return a.join(b, list(by)).where(F.col("client_a") < F.col("client_b"))


# J1 -------------------------------------------------------------------------------
def aggregation_gate(imp: DataFrame, min_clients: int = 2, client: str = "client_id") -> DataFrame:
    """Keep rounds with at least ``min_clients`` reporting clients, and per round
    only the methods that every reporting client has."""
    per_round = imp.groupBy("round").agg(F.count_distinct(client).alias("_nc"))
    per_method = imp.groupBy("round", "method").agg(F.count_distinct(client).alias("_nm"))
    ok = (per_method.join(per_round, "round")
          .where((F.col("_nc") >= min_clients) & (F.col("_nm") == F.col("_nc"))).select("round", "method"))
    return imp.join(ok, ["round", "method"], "left_semi")


# J2 -------------------------------------------------------------------------------
def zscore_filter(imp: DataFrame, threshold: float = ZSCORE_THRESHOLD, min_values: int = 4) -> DataFrame:
    """Per (round, method, feature) with at least ``min_values`` values: drop
    values with |z| >= threshold (population std); std 0 keeps all."""
    w = Window.partitionBy(*KEYS)
    d = imp.select("*", F.count(F.lit(1)).over(w).alias("_n"), F.avg("value").over(w).alias("_m"),
                   F.stddev_pop("value").over(w).alias("_sd"))
    keep = ((F.col("_n") < min_values) | (F.col("_sd") == 0) | F.col("_sd").isNull()
            | (F.abs((F.col("value") - F.col("_m")) / F.col("_sd")) < threshold))
    return d.where(keep).drop("_n", "_m", "_sd")


# J3 / J5 / J6 -------------------------------------------------------------------------
def aggregate_simple(imp: DataFrame) -> DataFrame:
    return imp.groupBy(*KEYS).agg(F.avg("value").alias("value"))


def aggregate_median(imp: DataFrame) -> DataFrame:
    return imp.groupBy(*KEYS).agg(F.median("value").alias("value"))


def aggregate_trimmed(imp: DataFrame, fraction: float = TRIM_FRACTION, min_values: int = 5) -> DataFrame:
    """n >= min_values: drop max(1, int(fraction*n)) values from each end
    (by value), average the rest; otherwise the plain mean."""
    w = Window.partitionBy(*KEYS)
    d = imp.select(*KEYS, "value", F.count(F.lit(1)).over(w).alias("_n"),
                   F.row_number().over(w.orderBy("value")).alias("_r"))
    t = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction)))
    keep = (F.col("_n") < min_values) | ((F.col("_r") > t) & (F.col("_r") <= F.col("_n") - t))
    return d.where(keep).groupBy(*KEYS).agg(F.avg("value").alias("value"))


# J4 -------------------------------------------------------------------------------
def aggregate_weighted(imp: DataFrame, client_state: DataFrame, client: str = "client_id",
                       weight: str = "contribution_score") -> DataFrame:
    """Σ v·s / Σ s over the clients that reported the feature (aligned by
    client id); the state table has one row per client."""
    j = imp.join(client_state.select(client, weight), client, "left")
    s = F.coalesce(F.col(weight), F.lit(1.0))
    return j.groupBy(*KEYS).agg((F.sum(F.col("value") * s) / F.sum(s)).alias("value"))


# J7 -------------------------------------------------------------------------------
def full_feature_grid(agg: DataFrame) -> DataFrame:
    """Every (round, method) paired with every feature seen for the method; the
    feature list per method is one array (bounded by the feature count), joined
    on method and exploded — no cross join."""
    feats = agg.groupBy("method").agg(F.array_sort(F.collect_set("feature")).alias("_fs"))
    rounds = agg.select("round", "method").distinct()
    grid = rounds.join(feats, "method").select("round", "method", F.explode("_fs").alias("feature"))
    return grid.join(agg, KEYS, "left").select(*KEYS, F.coalesce("value", F.lit(0.0)).alias("value"))


def temporal_decay(agg: DataFrame, decay: float = TEMPORAL_DECAY) -> DataFrame:
    """g_1 = a_1; g_k = d·a_k + (1-d)·g_(k-1) over the aggregated rounds in order
    (k = position among rounds); features nobody reported enter as 0.
    Closed form: g_k = Σ_(i<=k) c_i (1-d)^(k-i) a_i with c_1 = 1, c_i = d."""
    g = full_feature_grid(agg)
    pos = g.select("method", "round").distinct().withColumn(
        "_k", F.row_number().over(Window.partitionBy("method").orderBy("round")))
    g = g.join(pos, ["method", "round"])
    q = 1.0 - decay
    c = F.when(F.col("_k") == 1, F.lit(1.0)).otherwise(F.lit(decay))
    hist = Window.partitionBy("method", "feature").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    terms = F.collect_list(F.struct("_k", (c * F.col("value")).alias("_cv"))).over(hist)
    out = g.select(*KEYS, "_k", terms.alias("_t"))
    val = F.aggregate("_t", F.lit(0.0),
                      lambda acc, x: acc + x["_cv"] * F.pow(F.lit(q), F.col("_k") - x["_k"]))
    return out.select(*KEYS, val.alias("value"))


# J8 / J9 ----------------------------------------------------------------------------
def ranked_lists(imp: DataFrame, by: Sequence[str] = ("round", "method"), client: str = "client_id") -> DataFrame:
    """Rank of each feature within its client's list: |value| descending,
    feature name ascending on ties (1-based)."""
    w = Window.partitionBy(*by, client).orderBy(F.desc(F.abs("value")), F.asc("feature"))
    return imp.select(*by, client, "feature", F.row_number().over(w).alias("rank"),
                      F.count(F.lit(1)).over(Window.partitionBy(*by, client)).alias("list_len"))


def _pairs_on_features(r: DataFrame, by: Sequence[str], client: str) -> DataFrame:
    a = r.select(*by, F.col(client).alias("client_a"), "feature", F.col("rank").alias("rank_a"),
                 F.col("list_len").alias("len_a"))
    b = r.select(*by, F.col(client).alias("client_b"), "feature", F.col("rank").alias("rank_b"),
                 F.col("list_len").alias("len_b"))
    return a.join(b, [*by, "feature"]).where(F.col("client_a") < F.col("client_b"))


def agreement_spearman(imp: DataFrame, by: Sequence[str] = ("round", "method"),
                       client: str = "client_id") -> DataFrame:
    """max(0, (ρ+1)/2) of the ranks of the common features, re-ranked within the
    pair; 1 common feature -> 1; none -> 0 (pairs come from ``client_pairs``)."""
    by = list(by)
    r = cut_lineage(ranked_lists(imp, by, client))      # ranked once; pairs and both sides of the join read it
    common = _pairs_on_features(r, by, client)
    pk = [*by, "client_a", "client_b"]
    common = common.select(*pk, F.row_number().over(Window.partitionBy(*pk).orderBy("rank_a")).alias("ra"),
                           F.row_number().over(Window.partitionBy(*pk).orderBy("rank_b")).alias("rb"))
    s = common.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"),
                                F.sum(F.pow(F.col("ra") - F.col("rb"), 2)).alias("d2"))
    n = F.col("n").cast("double")
    rho = F.lit(1.0) - F.lit(6.0) * F.col("d2") / (n * (n * n - 1))
    sim = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (rho + 1) / 2))
    pairs = client_pairs(r, by, client)
    return pairs.join(s.select(*pk, sim.alias("agreement")), pk, "left").select(
        *pk, F.coalesce("agreement", F.lit(0.0)).alias("agreement"))


def agreement_rbo(imp: DataFrame, p: float = RBO_P, by: Sequence[str] = ("round", "method"),
                  client: str = "client_id") -> DataFrame:
    """Truncated, renormalised rank-biased overlap to depth D = min(len_a, len_b):
    Σ_d w_d·|A_d ∩ B_d|/d ÷ Σ_d w_d with w_d = (1-p)p^(d-1). A common feature
    counts at every depth d >= max(rank_a, rank_b). D = 0 -> 0."""
    by = list(by)
    r = cut_lineage(ranked_lists(imp, by, client))      # ranked once; pairs and both sides of the join read it
    common = _pairs_on_features(r, by, client)
    pk = [*by, "client_a", "client_b"]
    depth = F.least("len_a", "len_b")
    # one row per common feature that is inside the depth: contributes to depths m..D
    c = common.select(*pk, F.greatest("rank_a", "rank_b").alias("m"), depth.alias("D")).where(F.col("m") <= F.col("D"))
    # Σ_{d=m..D} w_d / d as an array aggregate over the (short) depth range
    contrib = F.aggregate(F.sequence(F.col("m"), F.col("D")), F.lit(0.0),
                          lambda acc, dd: acc + F.lit(1 - p) * F.pow(F.lit(p), dd - 1) / dd)
    num = c.groupBy(*pk).agg(F.sum(contrib).alias("num"))
    pairs = client_pairs(r, by, client)
    lens = r.select(*by, client, "list_len").distinct()
    pl = (pairs.join(lens.withColumnRenamed(client, "client_a").withColumnRenamed("list_len", "len_a"), [*by, "client_a"])
          .join(lens.withColumnRenamed(client, "client_b").withColumnRenamed("list_len", "len_b"), [*by, "client_b"]))
    D = F.least("len_a", "len_b")
    den = F.lit(1.0) - F.pow(F.lit(p), D)  # Σ_{d=1..D} (1-p) p^(d-1)
    out = pl.join(num, pk, "left")
    val = F.when(D == 0, F.lit(0.0)).otherwise(F.coalesce(F.col("num"), F.lit(0.0)) / den)
    return out.select(*pk, val.alias("agreement"))


# J10 ------------------------------------------------------------------------------
def agreement_matrix(pairs: DataFrame, imp: DataFrame, by: Sequence[str] = ("round", "method"),
                     client: str = "client_id") -> DataFrame:
    """Symmetric matrix: (a,b), (b,a) and the diagonal (a,a)=1."""
    by = list(by)
    ab = pairs.select(*by, "client_a", "client_b", "agreement")
    ba = pairs.select(*by, F.col("client_b").alias("client_a"), F.col("client_a").alias("client_b"), "agreement")
    diag = imp.select(*by, client).distinct().select(*by, F.col(client).alias("client_a"),
                                                     F.col(client).alias("client_b"), F.lit(1.0).alias("agreement"))
    return ab.unionByName(ba).unionByName(diag)


# J11 / J12 / J13 ---------------------------------------------------------------------
def round_filter(imp: DataFrame, rounds: Sequence[int] | None = None) -> DataFrame:
    return imp if rounds is None else imp.where(F.col("round").isin(list(rounds)))


def latest_round(imp: DataFrame, client: str | None = None, client_col: str = "client_id") -> DataFrame:
    d = imp if client is None else imp.where(F.col(client_col) == client)
    last = d.agg(F.max("round").alias("round"))
    return d.join(last, "round", "left_semi")


def aggregation_metadata(imp: DataFrame, method_name: str, client: str = "client_id") -> DataFrame:
    return imp.groupBy("round").agg(F.count_distinct(client).alias("client_count"),
                                    F.array_sort(F.collect_set(client)).alias("client_ids"),
                                    F.lit(method_name).alias("aggregation_method"))
