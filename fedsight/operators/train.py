"""Partition-wise training with parameter averaging (F2-F8).

Model: logistic regression on a fixed, ordered feature list. A weights table is
small (clients x (d + 1)) and wide: (client_id, _w array<double>, _b double).

One local step (full batch, FedAvg with B = ∞) is ONE grouped aggregate over
the rows: each row is scored with its client's weights (broadcast join of the
small weights table) and contributes c_y·(p - y)·x_j to d + 1 sums. Rows never
leave their partition except as partial sums. The global model is the
(optionally size-weighted) average of the clients' vectors; each round's
result is checkpointed to the shared checkpoint folder, so the lineage stays
one round long and an executor loss only re-runs that round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.functions.exprs import sigmoid
from fedsight.functions.parallel import run_settings
from fedsight.operators import evaluate as ev
from fedsight.operators import sample as sp
from fedsight.session import cut_lineage


# F4 ------------------------------------------------------------------------------
def margin_expr(features: Sequence[str], w: Column, b: Column) -> Column:
    """Σ x_j·w[j] + b as plain arithmetic (codegen-friendly; ``w`` may be an
    array column or a scalar subquery)."""
    out = None
    for i, f in enumerate(features):
        t = F.col(f).cast("double") * w[i]
        out = t if out is None else out + t
    return out + b


def score_linear(df: DataFrame, features: Sequence[str], weights: Sequence[float], bias: float = 0.0,
                 threshold: float = 0.5) -> DataFrame:
    """Probability pair and class (p > threshold, strict) for fixed weights."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    p = sigmoid(margin_expr(features, w, F.lit(float(bias))))
    return df.withColumn("prob_1", p).withColumn("prob_0", F.lit(1.0) - F.col("prob_1")).withColumn(
        "pred", (F.col("prob_1") > threshold).cast("int"))


def score_with(df: DataFrame, features: Sequence[str], model: DataFrame, by: Sequence[str] = (),
               broadcast_weights: bool | None = None) -> DataFrame:
    """Score rows with a weights table: per-client (``by``) or one global row
    (applied as scalar subqueries, no join)."""
    if by:
        j = df.join(_maybe_broadcast(model.select(*by, "_w", "_b"), broadcast_weights), list(by))
        return j.withColumn("score", sigmoid(margin_expr(features, F.col("_w"), F.col("_b")))).drop("_w", "_b")
    w, b = model.select("_w").scalar(), model.select("_b").scalar()
    return df.withColumn("score", sigmoid(margin_expr(features, w, b)))


# F1 for local data -------------------------------------------------------------------
def local_class_weights(rows: DataFrame, client: str = "client_id", label: str = "label") -> DataFrame:
    """n_c / (k_c · n_c,y) per client and class (balanced weights on local data)."""
    c = rows.groupBy(client, label).agg(F.count(F.lit(1)).alias("_ny"))
    t = c.groupBy(client).agg(F.sum("_ny").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.join(t, client).select(client, label, (F.col("_n") / (F.col("_k") * F.col("_ny"))).alias("_cw"))


def zero_model(d: int) -> Column:
    return F.array(*[F.lit(0.0)] * d)


# F5 ------------------------------------------------------------------------------
MAX_BROADCAST_BYTES = 64 << 20


def weights_fit_broadcast(n_clients: int, d: int) -> bool:
    """Proven size bound of a weights table: clients x (d + 1) doubles (+ key)."""
    return n_clients * (d + 2) * 8 * 2 <= MAX_BROADCAST_BYTES


def _maybe_broadcast(df: DataFrame, decision: bool | None) -> DataFrame:
    """A hint only where the caller has proven the size; else the planner decides."""
    return F.broadcast(df) if decision else df


def local_step(rows: DataFrame, features: Sequence[str], client_w: DataFrame, cw: DataFrame | None,
               lr: float, l2: float = 0.0, client: str = "client_id", label: str = "label",
               broadcast_weights: bool | None = None) -> DataFrame:
    """One full-batch gradient step per client: w <- w - lr·(Σ c_y (p-y) x / n + l2·w).
    ``broadcast_weights``: decided by the caller from the client count (a proven
    bound), else left to the planner."""
    d = len(features)
    j = rows.join(_maybe_broadcast(client_w, broadcast_weights), client)
    if cw is not None:
        j = j.join(_maybe_broadcast(cw, broadcast_weights), [client, label], "left")
        c = F.coalesce(F.col("_cw"), F.lit(1.0))
    else:
        c = F.lit(1.0)
    r = c * (sigmoid(margin_expr(features, F.col("_w"), F.col("_b"))) - F.col(label).cast("double"))
    # the residual is projected once per row; the d + 1 sums then only multiply
    j = j.select(client, r.alias("_r"), "_w", "_b", *features)
    # the old weights are kept as d numbers: an array in the aggregate would sort every row by client
    g = j.groupBy(client).agg(F.count(F.lit(1)).alias("_n"),
                              *[F.sum(F.col("_r") * F.col(f).cast("double")).alias(f"_g{i}") for i, f in enumerate(features)],
                              F.sum("_r").alias("_gb"), *[F.first(F.col("_w")[i]).alias(f"_w{i}") for i in range(d)],
                              F.first("_b").alias("_b"))
    neww = F.array(*[F.col(f"_w{i}") - F.lit(lr) * (F.col(f"_g{i}") / F.col("_n") + F.lit(l2) * F.col(f"_w{i}"))
                     for i in range(d)])
    # the old weights came through the aggregate: no second use of client_w, so a plan grows by one step an epoch
    return g.select(client, neww.alias("_w"), (F.col("_b") - F.lit(lr) * F.col("_gb") / F.col("_n")).alias("_b"),
                    F.col("_n").alias("data_size"))


def local_train(rows: DataFrame, features: Sequence[str], start: DataFrame, local_epochs: int = 1, lr: float = 0.1,
                l2: float = 0.0, class_weighted: bool = True, client: str = "client_id", label: str = "label",
                broadcast_weights: bool | None = None,
                class_weights: DataFrame | None = None) -> DataFrame:
    """``local_epochs`` full-batch steps per client from ``start``; balanced class
    weights of each client's rows unless given (per client, so a loop can
    compute them once)."""
    cw = (class_weights if class_weights is not None else local_class_weights(rows, client, label)) \
        if class_weighted else None
    w = start.select(client, "_w", "_b")
    out = None
    for e in range(local_epochs):
        out = local_step(rows, features, w, cw, lr, l2, client, label, broadcast_weights)
        if e < local_epochs - 1:
            out = cut_lineage(out)      # a few weight rows; the next epoch's plan starts from them
        w = out.select(client, "_w", "_b")
    return out


# F6 ------------------------------------------------------------------------------
def fedavg(local: DataFrame, d: int, weighted: bool = False) -> DataFrame:
    """Element-wise mean of the clients' vectors (optionally weighted by data size)."""
    wt = F.col("data_size").cast("double") if weighted else F.lit(1.0)
    aggs = [(F.sum(F.col("_w")[i] * wt) / F.sum(wt)).alias(f"_a{i}") for i in range(d)]
    g = local.agg(*aggs, (F.sum(F.col("_b") * wt) / F.sum(wt)).alias("_ab"),
                  F.count(F.lit(1)).alias("n_clients"))
    return g.select(F.array(*[F.col(f"_a{i}") for i in range(d)]).alias("_w"), F.col("_ab").alias("_b"), "n_clients")


def to_long(model: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Wide weights -> (by..., idx, value); the bias is idx = d."""
    x = model.select(*by, F.posexplode(F.concat("_w", F.array("_b"))).alias("idx", "value"))
    return x.withColumn("value", F.round("value", digits)) if digits is not None else x


# F7 ------------------------------------------------------------------------------
@dataclass
class FederatedRun:
    model: DataFrame            # final global weights (wide, one row)
    weights: DataFrame          # (round, idx, value) global weights per round
    global_metrics: DataFrame   # (round, accuracy, auc) on the held-out rows
    client_metrics: DataFrame   # (round, client_id, accuracy, auc) local model on local rows
    contributions: DataFrame    # (client_id, contribution_score, last_update, n_rounds)


def fedavg_train(rows: DataFrame, features: Sequence[str], rounds: int = 2, fraction: float = 1.0,
                 local_epochs: int = 1, lr: float = 0.1, l2: float = 0.0, min_clients: int = 1,
                 test: DataFrame | None = None, weighted: bool = False, class_weighted: bool = True,
                 seed: int = 42, client: str = "client_id", label: str = "label") -> FederatedRun:
    """The federated loop: per round select clients, start them from the global
    model, train locally, average, evaluate. The driver only sequences rounds;
    every round's work is Spark aggregates and the round's (tiny) results are
    checkpointed."""
    d = len(features)
    # every round reads the rows again: materialise the (column-pruned) inputs once
    rows = cut_lineage(rows.select(client, label, *features))
    if test is not None:
        test = cut_lineage(test.select(label, *features))
    clients = rows.select(client).distinct()
    n_clients = clients.count()
    if n_clients < min_clients:
        raise ValueError(f"{n_clients} clients < min_clients {min_clients}")
    bcast = weights_fit_broadcast(n_clients, d)  # client lists / weight tables: n_clients rows
    # a client's class weights depend only on its own rows: compute them once (clients x 2 rows)
    cw = cut_lineage(local_class_weights(rows, client, label)) if class_weighted else None
    spark = rows.sparkSession
    glob = cut_lineage(spark.range(1).select(zero_model(d).alias("_w"), F.lit(0.0).alias("_b")))
    per_round_w, per_round_m, per_client_m = [], [], []
    for r in range(1, rounds + 1):
        sel = sp.select_clients(clients.withColumn("round", F.lit(r)), client, "round", fraction, seed)
        start = sel.select(client, glob.select("_w").scalar().alias("_w"), glob.select("_b").scalar().alias("_b"))
        local = cut_lineage(local_train(rows.join(_maybe_broadcast(sel.select(client), bcast), client, "left_semi"), features,
                                        start, local_epochs, lr, l2, class_weighted, client, label,
                                        broadcast_weights=bcast, class_weights=cw))
        glob = cut_lineage(fedavg(local, d, weighted).select("_w", "_b"))
        per_round_w.append(to_long(glob).withColumn("round", F.lit(r)))
        scored_local = score_with(rows.join(_maybe_broadcast(sel.select(client), bcast), client, "left_semi"), features, local,
                                  [client], broadcast_weights=bcast)
        scored_local = scored_local.withColumn("pred", (F.col("score") > 0.5).cast("int"))
        per_client_m.append(ev.metrics(scored_local, [client], label=label, digits=None).withColumn("round", F.lit(r)))
        if test is not None:
            st = score_with(test, features, glob).withColumn("pred", (F.col("score") > 0.5).cast("int"))
            per_round_m.append(ev.metrics(st, [], label=label, digits=None).withColumn("round", F.lit(r)))

    def union(xs):
        out = xs[0]
        for x in xs[1:]:
            out = out.unionByName(x)
        return out

    cm = union(per_client_m)
    gm = union(per_round_m) if per_round_m else None
    contrib = ev.contribution_scores(cm.select(client, "round", "auc"), client)
    return FederatedRun(glob, union(per_round_w), gm, cm, contrib)


# F8 ------------------------------------------------------------------------------
def weight_importance(first_layer: DataFrame, row: str = "idx", by: Sequence[str] = ()) -> DataFrame:
    """mean(|w|) of each input row of the first layer (one value per feature)."""
    return first_layer.groupBy(*by, row).agg(F.avg(F.abs("value")).alias("importance"))


# F2 / F3 (pyspark.ml) -----------------------------------------------------------------
def _vectorised(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))


def fit_classifier(train: DataFrame, features: Sequence[str], label: str = "label", hidden: Sequence[int] | None = None,
                   max_iter: int = 100, reg: float = 0.0, class_weighted: bool = True, seed: int = 42):
    """Central fit: LogisticRegression with balanced class weights, or an MLP
    (``hidden`` layer sizes) — both distributed pyspark.ml estimators. The MLP
    takes no weights; balanced classes are an error there, not ignored, so ask
    for ``class_weighted=False``."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    data = _vectorised(train, features)
    if hidden:
        if class_weighted:
            raise ValueError("the multilayer perceptron takes no class weights: pass class_weighted=False")
        est = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, seed=seed,
                                             layers=[len(features), *hidden, 2])
        return est.fit(data.withColumn(label, F.col(label).cast("double")))
    if class_weighted:
        data = sp.with_class_weight(data, label, "class_weight")
    est = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=reg,
                             weightCol="class_weight" if class_weighted else None)
    return est.fit(data.withColumn(label, F.col(label).cast("double")))


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    out = model.transform(_vectorised(df, features))
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn(
        "pred", (F.col("score") > 0.5).cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def param_search(train: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label",
                 reg_params: Sequence[float] = (0.0, 0.01, 0.1), max_iters: Sequence[int] = (20, 100),
                 hidden_sizes: Sequence[Sequence[int]] = (), validation: float = 0.2, class_weighted: bool = True, seed: int = 42,
                 parallel: int = 4):
    """Fit every setting on the train part of a stratified split by ``keys`` (a
    hash draw, so it does not depend on partitioning) and keep the best
    validation AUC: logistic models for each pair of ``reg_params`` and
    ``max_iters`` (with balanced class weights), perceptrons for each of
    ``hidden_sizes`` and ``max_iters``. ``parallel`` settings are fitted at the
    same time on one split, written once; one that fails is named in the error.
    Returns the best model (ties: the first setting) and the rows (hidden,
    reg_param, max_iter, val_auc) in the order of the settings."""
    from fedsight.sources.io import fresh_path
    spark = train.sparkSession
    path = fresh_path(spark, "search-split")
    sp.stratified_split(train.select(*keys, label, *features), label, list(keys), validation, seed).write.parquet(path)
    grid = [(None, r, m) for r in reg_params for m in max_iters] + [(tuple(h), 0.0, m) for h in hidden_sizes for m in max_iters]

    def fit(setting):
        hidden, reg, max_iter = setting
        split = spark.read.parquet(path)               # a plan of its own: threads share no plan objects
        part, held = split.where("split = 'train'"), split.where("split = 'test'")
        model = fit_classifier(part, features, label, hidden, max_iter, reg, class_weighted and not hidden, seed)
        return model, ev.roc_auc(predict(model, held, features), label).first()["auc"]

    def named(setting):
        return "(hidden={}, reg_param={}, max_iter={})".format(*setting)

    fitted = run_settings(spark, grid, fit, parallel, named)
    best = max(fitted, key=lambda f: f[1] or 0.0)[0]
    return best, [("-".join(map(str, hidden or ())), float(reg), int(max_iter), auc) for (hidden, reg, max_iter), (_, auc) in zip(grid, fitted)]
