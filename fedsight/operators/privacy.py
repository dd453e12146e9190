"""Clipping and Laplace noise for released importances.

Noise comes from hash draws keyed by the released row when ``deterministic``
(reproducible, testable) or from ``rand()`` otherwise (real releases). Each
released value gets the full ε, so a release of k values spends k·ε in total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedsight.functions.constants import DEFAULT_SENSITIVITY, PRIVACY_EPSILONS
from fedsight.functions.draws import fresh_uniform, laplace, uniform


def clip_importance(df: DataFrame, lo: float = -1.0, hi: float = 1.0, col: str = "value") -> DataFrame:
    return df.withColumn(col, F.least(F.greatest(F.col(col), F.lit(float(lo))), F.lit(float(hi))))


def sensitivity(clip_range: tuple[float, float] | None) -> float:
    return (clip_range[1] - clip_range[0]) if clip_range else DEFAULT_SENSITIVITY


def laplace_noise(df: DataFrame, epsilon: float, keys: Sequence[str], clip_range: tuple[float, float] | None = None,
                  seed: int = 42, deterministic: bool = False, col: str = "value") -> DataFrame:
    """Optionally clip, then add Laplace(0, sensitivity/ε) noise; no re-clip. The
    noise is unpredictable unless ``deterministic``: then anyone who knows keys
    and seed can take it away again, so that is for tests and simulations only."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    out = clip_importance(df, *clip_range, col=col) if clip_range else df
    u = uniform(*keys, seed=seed) if deterministic else fresh_uniform()
    b = sensitivity(clip_range) / float(epsilon)
    return out.withColumn(col, F.col(col) + laplace(u, b))


def epsilon_sweep(imp: DataFrame, keys: Sequence[str], epsilons: Sequence[float | None] = PRIVACY_EPSILONS,
                  clip_range: tuple[float, float] | None = (-1.0, 1.0), seed: int = 42,
                  group: Sequence[str] = ("client_id", "round", "method")) -> DataFrame:
    """Per privacy level: the released (clipped, noised) value next to the clean
    one, and the feature's rank shift inside its list. The levels are a short
    literal array exploded per row (no join)."""
    levels = F.array(*[F.struct(F.lit(e).cast("double").alias("epsilon"),
                                F.lit("none" if e is None else str(float(e))).alias("privacy_level"))
                       for e in epsilons])
    d = imp.withColumn("_lv", F.explode(levels)).select("*", "_lv.epsilon", "_lv.privacy_level").drop("_lv")
    clean = F.least(F.greatest(F.col("value"), F.lit(clip_range[0])), F.lit(clip_range[1])) if clip_range else F.col("value")
    b = F.lit(sensitivity(clip_range)) / F.col("epsilon")
    noise = F.when(F.col("epsilon").isNull(), F.lit(0.0)).otherwise(
        laplace(uniform(*keys, "privacy_level", seed=seed), b))
    d = d.withColumn("clean_value", clean).withColumn("released", F.col("clean_value") + noise)
    g = [*group, "privacy_level"]
    r_clean = F.row_number().over(Window.partitionBy(*g).orderBy(F.desc(F.abs("clean_value")), "feature"))
    r_rel = F.row_number().over(Window.partitionBy(*g).orderBy(F.desc(F.abs("released")), "feature"))
    return d.withColumn("rank_clean", r_clean).withColumn("rank_released", r_rel)


def sweep_summary(sweep: DataFrame, by: Sequence[str] = ("method",), digits: int = 6) -> DataFrame:
    """I4 utility numbers per privacy level: mean absolute error and mean rank shift."""
    return sweep.groupBy(*by, "privacy_level", "epsilon").agg(
        F.round(F.avg(F.abs(F.col("released") - F.col("clean_value"))), digits).alias("mean_abs_error"),
        F.round(F.avg(F.abs(F.col("rank_released") - F.col("rank_clean"))), digits).alias("mean_rank_shift"),
        F.count(F.lit(1)).alias("n_values"))
