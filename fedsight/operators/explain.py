"""Batch explanations (H1-H4, H9, K6) as Spark jobs.

The per-row explainer libraries of the reference are re-aimed as batch jobs.
Bins and linear attributions are plain column expressions. LIME and Kernel
SHAP run as ``mapInPandas`` over the distributed instances: a task perturbs,
scores and solves one instance at a time in NumPy, for any model that scores a
matrix of rows. The closures hold what is bounded by definition (the model,
4 bin statistics a feature, the background sample, the shared coalitions) and
no reference to this package, so executors need not have it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_EXACT_FEATURES = 16


# H1 ------------------------------------------------------------------------------
def quartile_cuts(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, q1, q2, q3): exact training quartiles (functions/quantiles.py),
    returned as a d-row table."""
    from fedsight.functions.quantiles import quantile_values
    qv = quantile_values(train, list(features), [0.25, 0.5, 0.75])
    rows = [(f, qv[(f, 0.25)], qv[(f, 0.5)], qv[(f, 0.75)]) for f in features]
    return train.sparkSession.createDataFrame(rows, "feature string, q1 double, q2 double, q3 double")


def bin_index(x: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """Number of cuts strictly below x: x <= q1 -> 0, ..., x > q3 -> 3."""
    return (x > q1).cast("int") + (x > q2).cast("int") + (x > q3).cast("int")


def bin_condition(name: Column, b: Column, q1: Column, q2: Column, q3: Column) -> Column:
    # fixed formats of the bin labels (as the local-surrogate explainer prints them)
    f = lambda q: F.format_string("%.2f", q)
    return (F.when(b == 0, F.concat(name, F.lit(" <= "), f(q1)))
            .when(b == 1, F.concat(f(q1), F.lit(" < "), name, F.lit(" <= "), f(q2)))
            .when(b == 2, F.concat(f(q2), F.lit(" < "), name, F.lit(" <= "), f(q3)))
            .otherwise(F.concat(name, F.lit(" > "), f(q3))))


def quartile_bins(rows: DataFrame, features: Sequence[str], key: str, cuts: DataFrame) -> DataFrame:
    """Long (key, feature, value, bin, condition) for every row and feature."""
    stack = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = rows.selectExpr(key, f"stack({len(features)}, {stack}) AS (feature, value)")
    j = long.join(F.broadcast(cuts), "feature")  # one row per feature
    b = bin_index(F.col("value"), F.col("q1"), F.col("q2"), F.col("q3"))
    return j.select(key, "feature", "value", b.alias("bin"),
                    bin_condition(F.col("feature"), b, F.col("q1"), F.col("q2"), F.col("q3")).alias("condition"))


# H4 ------------------------------------------------------------------------------
def linear_shap(rows: DataFrame, features: Sequence[str], key: str, weights: Sequence[float], bias: float,
                background: DataFrame) -> DataFrame:
    """Exact SHAP of the linear margin: φ_j = w_j (x_j - E_bg[x_j]); base value =
    E_bg[margin]; Σφ = margin(x) - base. The d background means come from one
    aggregate and enter as literals."""
    means = background.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()  # d numbers
    mu = {f: F.lit(means[f]).cast("double") for f in features}
    base = F.lit(float(bias))
    for w, f in zip(weights, features):
        base = base + F.lit(float(w)) * mu[f]
    parts = F.array(*[F.struct(F.lit(f).alias("feature"),
                               (F.lit(float(w)) * (F.col(f).cast("double") - mu[f])).alias("phi"))
                      for w, f in zip(weights, features)])
    return rows.select(key, F.explode(parts).alias("_p"), base.alias("base_value")).select(
        key, "_p.feature", "_p.phi", "base_value")


# H9 ------------------------------------------------------------------------------
def global_feature_importance(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def importance_by_method(rows: DataFrame, features: Sequence[str], key: str, scorer, background: DataFrame, method: str = "shap",
                         sizes: Sequence[int] = (100,), nsamples: int | None = None, seed: int = 42, exact: bool = False) -> DataFrame:
    """(method, n_samples, feature, importance, std_error, n_rows): the mean |value|
    of each feature over ``n_samples`` explained rows, for each of ``sizes``, and
    the standard error of that mean (null for one row).

    ``method``: shap (Kernel SHAP against ``background``) or lime (weights on
    quartile bins of ``background``, whole lists). Samples are nested: the rows
    with the smallest hash draws, so one explanation pass over the largest
    serves all sizes. A size above the number of rows takes them all.
    """
    from fedsight.functions.draws import uniform
    if method not in ("shap", "lime"):
        raise ValueError(f"unknown method {method}")
    drawn = rows.select(key, *features).withColumn("_u", uniform(key, seed=seed))
    order = Window.orderBy("_u", key)                   # a sample of the largest size
    sample = drawn.orderBy("_u", key).limit(max(sizes)).withColumn("_place", F.row_number().over(order))
    if method == "shap":
        values = kernel_shap_batch(sample, background, features, key, nsamples=nsamples, seed=seed, exact=exact, scorer=scorer).select(key, "feature", F.col("phi").alias("_v"))
    else:
        values = lime_batch(sample, background, features, key, num_samples=nsamples or 1000, max_features=len(features), seed=seed, scorer=scorer).select(
            key, "feature", F.col("weight").alias("_v"))
    placed = values.join(sample.select(key, "_place"), key).withColumn("n_samples", F.explode(F.array(*[F.lit(int(n)) for n in sizes])))
    stats = placed.where(F.col("_place") <= F.col("n_samples")).groupBy("n_samples", "feature").agg(
        F.avg(F.abs("_v")).alias("importance"), F.stddev_samp(F.abs("_v")).alias("_s"), F.count(F.lit(1)).alias("n_rows"))
    return stats.select(F.lit(method).alias("method"), "n_samples", "feature", "importance", (F.col("_s") / F.sqrt("n_rows")).alias("std_error"), "n_rows")


# K6 ------------------------------------------------------------------------------
def attribution_ranking(phi: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("phi")), F.asc("feature"))
    return phi.withColumn("rank", F.row_number().over(w))


# scorers: a model as a function of a matrix -------------------------------------------
Scorer = Callable[[np.ndarray], np.ndarray]


def linear_scorer(weights: Sequence[float], bias: float) -> Scorer:
    """Probability of a logistic model for the rows of a matrix."""
    w, b = np.asarray(weights, dtype=float), float(bias)
    return lambda X: 1.0 / (1.0 + np.exp(-np.clip(X @ w + b, -700, 700)))


def fitted_scorer(model) -> Scorer:
    """Probability of class 1 of a fitted pyspark.ml logistic regression or
    multilayer perceptron (sigmoid hidden layers, softmax output), from its
    coefficients alone, so it can be shipped to tasks."""
    if hasattr(model, "coefficients"):
        return linear_scorer(model.coefficients.toArray(), model.intercept)
    sizes, flat, layers, at = list(model.getLayers()), model.weights.toArray(), [], 0
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        W = flat[at:at + n_in * n_out].reshape((n_out, n_in), order="F").T
        at += n_in * n_out
        layers.append((W, flat[at:at + n_out]))
        at += n_out

    def score(X):
        for i, (W, b) in enumerate(layers):
            X = X @ W + b
            if i < len(layers) - 1:
                X = 1.0 / (1.0 + np.exp(-np.clip(X, -700, 700)))
        e = np.exp(X - X.max(axis=1, keepdims=True))
        return (e / e.sum(axis=1, keepdims=True))[:, 1]
    return score


def _scorer(weights, bias, scorer) -> Scorer:
    if (scorer is None) == (weights is None):
        raise ValueError("give either weights and bias or a scorer")
    return scorer if scorer is not None else linear_scorer(weights, bias)


def _instances(instances: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    return instances.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))


# H2 ------------------------------------------------------------------------------
def lime_batch(instances: DataFrame, train: DataFrame, features: Sequence[str], key: str,
               weights: Sequence[float] | None = None, bias: float = 0.0, num_samples: int = 1000, max_features: int = 10,
               kernel_width: float | None = None, alpha: float = 1.0, seed: int = 42, scorer: Scorer | None = None) -> DataFrame:
    """Local surrogate per instance (Ribeiro et al. 2016) on quartile bins, for
    any model that scores a matrix of rows (``scorer``) or a logistic one.

    Per (instance, sample) every feature draws a bin from the training bin
    frequencies; z_j = 1 when it equals the instance's bin; the raw value is x_j
    then, else the drawn bin's training mean; sample 0 is x itself. Draws are
    seeded by the instance's key, so a retried task repeats them. Kernel
    π = sqrt(exp(-D²/σ²)), D² = Σ(1 - z_j), σ = 0.75·sqrt(d) by default. A
    weighted ridge (α, unpenalised intercept) of the model's probability on z is
    solved per instance; top ``max_features`` by |β|.

    Instances stay distributed: a task perturbs, scores and solves one instance
    at a time in NumPy (num_samples x d numbers); the closure holds the model
    and 4 x d bin statistics, which come from one grouped aggregate.
    """
    f, feats, d = _scorer(weights, bias, scorer), list(features), len(features)
    sigma = kernel_width if kernel_width is not None else 0.75 * math.sqrt(d)
    cuts = quartile_cuts(train, features)
    cut = {r["feature"]: (r["q1"], r["q2"], r["q3"]) for r in cuts.collect()}                    # d rows
    stats = (quartile_bins(train.withColumn("_k", F.lit(0)), features, "_k", cuts).groupBy("feature", "bin")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")).collect())            # 4 d rows
    q = np.array([cut[x] for x in feats], dtype=float)
    freq, mean = np.zeros((d, 4)), np.zeros((d, 4))
    for r in stats:
        freq[feats.index(r["feature"]), r["bin"]], mean[feats.index(r["feature"]), r["bin"]] = r["n"], r["m"]
    cum = np.cumsum(freq / np.maximum(freq.sum(axis=1, keepdims=True), 1), axis=1)
    conds = [[f"{x} <= {a:.2f}", f"{a:.2f} < {x} <= {b:.2f}", f"{b:.2f} < {x} <= {c:.2f}", f"{x} > {c:.2f}"]
             for x, (a, b, c) in zip(feats, q)]

    def explain(x, rng):
        xb = (x[:, None] > q).sum(axis=1)
        u = rng.random((num_samples, d))
        b = np.minimum((u[:, :, None] > cum[None]).sum(axis=2), 3)
        b[0] = xb
        z = (b == xb).astype(float)
        p = f(np.where(z == 1, x, mean[np.arange(d), b]))
        pi = np.sqrt(np.exp(-(1 - z).sum(axis=1) / sigma ** 2))
        zc, pc = z - (pi @ z) / pi.sum(), p - (pi @ p) / pi.sum()
        return xb, np.linalg.solve((zc * pi[:, None]).T @ zc + alpha * np.eye(d), zc.T @ (pi * pc))

    def run(batches):
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf["_x"]):
                xb, beta = explain(np.asarray(x, dtype=float), np.random.default_rng([seed, zlib.crc32(str(k).encode())]))
                order = sorted(range(d), key=lambda j: (-abs(beta[j]), feats[j]))[:max_features]
                out += [(k, feats[j], conds[j][int(xb[j])], float(beta[j]), rank) for rank, j in enumerate(order, start=1)]
            yield pd.DataFrame(out, columns=[key, "feature", "condition", "weight", "rank"])

    ktype = dict(instances.dtypes)[key]
    return _instances(instances, features, key).mapInPandas(run, f"{key} {ktype}, feature string, condition string, weight double, rank int")


# H3 ------------------------------------------------------------------------------
def kernel_size_weights(d: int) -> list[float]:
    """Kernel SHAP weight of ONE coalition of each size s = 0..d (0 for the
    empty and full coalitions, which enter through the constraint)."""
    return [0.0] + [(d - 1) / (math.comb(d, s) * s * (d - s)) for s in range(1, d)] + [0.0]


def coalitions(d: int, nsamples: int, exact: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks (one row a coalition) and weights, shared by all instances: every
    coalition with its kernel weight, or ``nsamples`` drawn ones, in pairs of a
    coalition and its complement, sizes by the kernel's distribution; equal draws
    are one with their number as weight."""
    if exact:
        bits = np.arange(1, (1 << d) - 1)
        masks = (bits[:, None] >> np.arange(d) & 1).astype(float)
        return masks, np.array(kernel_size_weights(d))[masks.sum(axis=1).astype(int)]
    rng = np.random.default_rng(seed)
    per_size = np.array([math.comb(d, s) * w for s, w in enumerate(kernel_size_weights(d))])[1:d]
    sizes = rng.choice(np.arange(1, d), size=(nsamples + 1) // 2, p=per_size / per_size.sum())
    masks = (np.argsort(np.argsort(rng.random((len(sizes), d)), axis=1), axis=1) < sizes[:, None]).astype(float)
    masks, weight = np.unique(np.concatenate([masks, 1 - masks])[:max(nsamples, 1)], axis=0, return_counts=True)
    return masks, weight.astype(float)


def kernel_shap_batch(instances: DataFrame, background: DataFrame, features: Sequence[str], key: str,
                      weights: Sequence[float] | None = None, bias: float = 0.0, nsamples: int | None = None, seed: int = 42,
                      exact: bool = False, max_background: int = 10_000, scorer: Scorer | None = None,
                      by: str | None = None, scorers: dict | None = None) -> DataFrame:
    """Kernel SHAP (Lundberg & Lee 2017) of a model's probability for a batch,
    for any model that scores a matrix of rows (``scorer``) or a logistic one,
    or for one model a value of column ``by`` (``scorers``; the column stays).

    v(S) is the mean over the background rows of f(x on S, background
    elsewhere); the regression is constrained to Σφ = f(x) - E f and solved by
    least squares, so too few or repeated coalitions give the smallest solution
    instead of an error; a single feature takes the whole difference.
    ``exact``: all 2^d - 2 coalitions (exact Shapley values; at most
    MAX_EXACT_FEATURES features, else an error); else ``nsamples`` (default
    2 d + 2048) shared ones are drawn.

    Instances stay distributed; a task handles one at a time in blocks of
    coalitions, so its memory is the background's size times a constant. The
    background is a bounded sample by definition (E8); more than
    ``max_background`` rows are refused.
    """
    if (by is None) != (scorers is None):
        raise ValueError("by and scorers go together")
    models = scorers if by else {None: _scorer(weights, bias, scorer)}
    feats, d = list(features), len(features)
    if exact and d > MAX_EXACT_FEATURES:
        raise ValueError(f"exact values of {d} features need 2^{d} coalitions; the limit is {MAX_EXACT_FEATURES}: give nsamples")
    rows = background.select(*[F.col(c).cast("double") for c in features]).limit(max_background + 1).collect()
    if not 0 < len(rows) <= max_background:
        raise ValueError(f"the background must have 1 to {max_background} rows")
    bg = np.array([list(r) for r in rows], dtype=float)
    masks, cw = coalitions(d, nsamples or 2 * d + 2048, exact, seed) if d > 1 else (np.zeros((0, 1)), np.zeros(0))
    block = max(1, 2_000_000 // (len(bg) * d))

    def explain(x, f, ef):
        fx = float(f(x[None])[0])
        if d == 1:
            return fx, np.array([fx - ef])
        v = np.concatenate([f((m[:, None, :] * x + (1 - m[:, None, :]) * bg[None]).reshape(-1, d)).reshape(len(m), -1).mean(axis=1)
                            for m in (masks[i:i + block] for i in range(0, len(masks), block))])
        last = masks[:, -1:]
        root = np.sqrt(cw)[:, None]
        phi = np.linalg.lstsq(root * (masks[:, :-1] - last), root[:, 0] * (v - ef - last[:, 0] * (fx - ef)), rcond=None)[0]
        return fx, np.append(phi, fx - ef - phi.sum())

    names = [key, *([by] if by else [])]

    def run(batches):
        base = {}
        for pdf in batches:
            out = []
            for *of, x in zip(*(pdf[c] for c in names), pdf["_x"]):
                who = of[1] if by else None
                if who not in base:
                    base[who] = float(models[who](bg).mean())
                fx, phi = explain(np.asarray(x, dtype=float), models[who], base[who])
                out += [(*of, name, float(v), base[who], fx) for name, v in zip(feats, phi)]
            yield pd.DataFrame(out, columns=[*names, "feature", "phi", "base_value", "prediction"])

    types = dict(instances.dtypes)
    rows = instances.select(*names, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    return rows.mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in names), "feature string, phi double, base_value double, prediction double"]))
