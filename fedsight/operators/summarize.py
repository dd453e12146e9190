"""Importance summaries of raw per-instance explanations.

Input: the long ``attribution`` table (client_id, round, instance_id, method,
feature, value) — one row per (instance, feature) weight. Summaries are grouped
aggregates; top-k uses a window partitioned by (client, round, method).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedsight.operators.clean import base_feature_name

G = ["client_id", "round", "method"]


def _feature_lists(attr: DataFrame) -> DataFrame:
    """The full feature list per method, as one (bounded) array per method."""
    return attr.groupBy("method").agg(F.array_sort(F.collect_set("feature")).alias("_fs"))


def _with_all_features(per: DataFrame, attr: DataFrame, group: Sequence[str] = G) -> DataFrame:
    groups = per.select(*group).distinct()
    grid = groups.join(_feature_lists(attr), "method").select(*group, F.explode("_fs").alias("feature"))
    return grid.join(per, [*group, "feature"], "left")


def importance_normalised(attr: DataFrame, from_conditions: bool = False) -> DataFrame:
    """Client flavour: Σ|v| per (base) feature ÷ number of explained instances,
    then normalised to sum 1 within (client, round, method)."""
    a = attr.withColumn("feature", base_feature_name("feature")) if from_conditions else attr
    n = a.groupBy(*G).agg(F.count_distinct("instance_id").alias("_n"))
    s = a.groupBy(*G, "feature").agg(F.sum(F.abs("value")).alias("_s"))
    per = s.join(n, G).withColumn("_v", F.col("_s") / F.col("_n"))
    tot = F.sum("_v").over(Window.partitionBy(*G))
    return per.select(*G, "feature", F.when(tot > 0, F.col("_v") / tot).otherwise(F.col("_v")).alias("value"))


def importance_mean_present(attr: DataFrame, k: int | None = None) -> DataFrame:
    """Model flavour: mean |v| over the instances where the feature occurs, 0
    for features never present; optionally the top-k."""
    per = attr.groupBy(*G, "feature").agg(F.avg(F.abs("value")).alias("value"))
    full = _with_all_features(per, attr).withColumn("value", F.coalesce("value", F.lit(0.0)))
    if k is None:
        return full
    w = Window.partitionBy(*G).orderBy(F.desc("value"), "feature")
    return full.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def importance_per_hit(attr: DataFrame) -> DataFrame:
    """Manager flavour: lime Σ|v| ÷ all (instance, feature) hits of the group;
    shap Σ|v| ÷ (hits / number of features)."""
    nfeat = attr.groupBy("method").agg(F.count_distinct("feature").alias("_nf"))
    hits = attr.groupBy(*G).agg(F.count(F.lit(1)).alias("_h"))
    s = attr.groupBy(*G, "feature").agg(F.sum(F.abs("value")).alias("_s"))
    j = s.join(hits, G).join(nfeat, "method")
    den = F.when(F.col("method") == "shap", F.col("_h") / F.col("_nf")).otherwise(F.col("_h"))
    return j.select(*G, "feature", (F.col("_s") / den).alias("value"))


def explanation_metadata(attr: DataFrame, labels: DataFrame, instance: str = "instance_id") -> DataFrame:
    """Per (client, round): sample size, positive ratio, explanation counts
    (all / per method) and feature count. Each distinct count is a dedupe
    aggregate followed by a plain count (no row-multiplying Expand)."""
    cr = ["client_id", "round"]
    expl = attr.select(*cr, instance, "method").distinct()
    e = expl.groupBy(*cr).agg(F.count(F.lit(1)).alias("explanation_count"),
                              F.count_if(F.col("method") == "lime").alias("lime_count"),
                              F.count_if(F.col("method") == "shap").alias("shap_count"))
    inst = expl.select(*cr, instance).distinct().join(labels.select(instance, "label"), instance, "left")
    a = inst.groupBy(*cr).agg(F.count(F.lit(1)).alias("sample_size"),
                              F.avg(F.col("label").cast("double")).alias("positive_ratio"))
    f = attr.select(*cr, "feature").distinct().groupBy(*cr).agg(F.count(F.lit(1)).alias("feature_count"))
    return a.join(e, cr).join(f, cr)
