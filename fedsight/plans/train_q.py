"""Queries for training and scoring (F2-F8) on the embedding rows
(64 features, label = class parity, client = id mod 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsight.operators import train as tr
from fedsight.plans.registry import query
from fedsight.sources import testbed as tb

D = tb.N_EMB_FEATURES
FEATS = [f"f{i}" for i in range(D)]
LR, L2 = 0.5, 0.01
FIXED_W = [0.3 * (1 if i % 2 == 0 else -1) * (i + 1) / D for i in range(D)]
FIXED_B = -0.1

TR = tb.with_ctes(tb.sql_training_rows(D))
CW = """cnt AS (SELECT client_id, label, count(*) AS ny FROM training_rows GROUP BY ALL),
tot AS (SELECT client_id, sum(ny) AS n, count(*) AS k FROM cnt GROUP BY 1),
cw AS (SELECT cnt.client_id, cnt.label, tot.n / (tot.k * cnt.ny) AS c FROM cnt JOIN tot ON cnt.client_id = tot.client_id)"""


def _margin(prefix: str = "W.") -> str:
    return " + ".join(f"{prefix}w{i} * t.f{i}" for i in range(D)) + f" + {prefix}b"


def sql_step(w_in: str, out: str, lr: float = LR) -> str:
    """CTE ``out`` = one local full-batch step from the weights CTE ``w_in``
    (client_id, w0..w{d-1}, b)."""
    gsum = ", ".join(f"sum(cw.c * (s.p - s.label) * s.f{i}) AS g{i}" for i in range(D))
    upd = ", ".join(f"W.w{i} - {lr} * (g.g{i} / g.n + {L2} * W.w{i}) AS w{i}" for i in range(D))
    return f"""{out}_s AS (SELECT t.*, 1.0 / (1.0 + exp(-({_margin()}))) AS p
            FROM training_rows t JOIN {w_in} W ON t.client_id = W.client_id),
{out}_g AS (SELECT s.client_id, count(*) AS n, {gsum}, sum(cw.c * (s.p - s.label)) AS gb
            FROM {out}_s s JOIN cw ON s.client_id = cw.client_id AND s.label = cw.label GROUP BY s.client_id),
{out} AS (SELECT g.client_id, {upd}, W.b - {lr} * (g.gb / g.n) AS b, g.n AS data_size
          FROM {out}_g g JOIN {w_in} W ON g.client_id = W.client_id)"""


ZERO = "w0_ AS (SELECT DISTINCT client_id, " + ", ".join(f"0.0 AS w{i}" for i in range(D)) + ", 0.0 AS b FROM training_rows)"


def sql_avg(w_in: str, out: str, weighted: bool = False) -> str:
    wt = "CAST(data_size AS DOUBLE)" if weighted else "1.0"
    cols = ", ".join(f"sum(w{i} * {wt}) / sum({wt}) AS w{i}" for i in range(D))
    return f"{out} AS (SELECT {cols}, sum(b * {wt}) / sum({wt}) AS b FROM {w_in})"


def sql_long(w_in: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    return " UNION ALL ".join(
        [f"SELECT {sel}{i} AS idx, round(w{i}, 6) AS value FROM {w_in}" for i in range(D)]
        + [f"SELECT {sel}{D} AS idx, round(b, 6) AS value FROM {w_in}"])


def _rows(spark, d):
    return tb.training_rows(spark, d)


def _zero_start(rows):
    return rows.select("client_id").distinct().select("client_id", tr.zero_model(D).alias("_w"), F.lit(0.0).alias("_b"))


def _local(spark, d, epochs=2):
    rows = _rows(spark, d)
    return tr.local_train(rows, FEATS, _zero_start(rows), local_epochs=epochs, lr=LR, l2=L2)


# F4
@query("score_linear", TR + f"""
SELECT vec_id, client_id, label, round(p, 9) AS prob_1, round(1.0 - p, 9) AS prob_0, CAST(p > 0.5 AS INTEGER) AS pred
FROM (SELECT t.*, 1.0 / (1.0 + exp(-({' + '.join(f'({FIXED_W[i]!r}) * t.f{i}' for i in range(D))} + ({FIXED_B!r})))) AS p
      FROM training_rows t) x""")
def q_score(spark, d):
    out = tr.score_linear(_rows(spark, d), FEATS, FIXED_W, FIXED_B)
    return out.select("vec_id", "client_id", "label", F.round("prob_1", 9).alias("prob_1"),
                      F.round("prob_0", 9).alias("prob_0"), "pred")


# two local epochs from the zero model, per client.
@query("local_train_step", TR + ",\n" + CW + ",\n" + ZERO + ",\n" + sql_step("w0_", "w1_") + ",\n"
       + sql_step("w1_", "w2_") + "\n" + sql_long("w2_", "client_id"))
def q_local_step(spark, d):
    return tr.to_long(_local(spark, d), ["client_id"], digits=6)


# five local epochs (the plan grows by one aggregate an epoch).
@query("local_train_epochs", TR + ",\n" + CW + ",\n" + ZERO + ",\n" + ",\n".join(sql_step(f"w{e}_", f"w{e + 1}_") for e in range(5))
       + "\n" + sql_long("w5_", "client_id"))
def q_local_epochs(spark, d):
    return tr.to_long(_local(spark, d, epochs=5), ["client_id"], digits=6)


# size-weighted average of those local models.
@query("fedavg_weights", TR + ",\n" + CW + ",\n" + ZERO + ",\n" + sql_step("w0_", "w1_") + ",\n"
       + sql_step("w1_", "w2_") + ",\n" + sql_avg("w2_", "avg_", weighted=True) + "\n" + sql_long("avg_"))
def q_fedavg(spark, d):
    return tr.to_long(tr.fedavg(_local(spark, d), D, weighted=True), digits=6)


# two rounds, all clients, one local epoch each, unweighted average.
_F7 = (TR + ",\n" + CW + ",\n" + ZERO + ",\n" + sql_step("w0_", "r1_") + ",\n" + sql_avg("r1_", "g1_") + ",\n"
       + "s2_ AS (SELECT c.client_id, g1_.* FROM (SELECT DISTINCT client_id FROM training_rows) c, g1_),\n"
       + sql_step("s2_", "r2_") + ",\n" + sql_avg("r2_", "g2_"))


def _run(spark, d):
    return tr.fedavg_train(_rows(spark, d), FEATS, rounds=2, fraction=1.0, local_epochs=1, lr=LR, l2=L2)


@query("fedavg_train", _F7 + "\n" + sql_long("g2_"))
def q_fedavg_train(spark, d):
    return tr.to_long(_run(spark, d).model, digits=6)


# F8: |w| per input of the trained global model (first and only layer).
@query("weight_importance", _F7 + "\n" + " UNION ALL ".join(
    f"SELECT {i} AS idx, round(abs(w{i}), 6) AS importance FROM g2_" for i in range(D)))
def q_weight_importance(spark, d):
    w = tr.to_long(_run(spark, d).model).where(F.col("idx") < D)
    return tr.weight_importance(w).withColumn("importance", F.round("importance", 6))


# F2 (rows check): central logistic regression with class weights; coefficients.
@query("fit_classifier")
def q_fit(spark, d):
    rows = _rows(spark, d)
    model = tr.fit_classifier(rows, FEATS, "label", max_iter=50)
    scored = tr.predict(model, rows, FEATS)
    from fedsight.operators import evaluate as ev
    return ev.metrics(scored, ["client_id"])


# F3 (rows check): grid of settings with validation AUC.
@query("param_search")
def q_param_search(spark, d):
    _, rows = tr.param_search(_rows(spark, d), FEATS, ["vec_id"], "label", reg_params=(0.0, 0.1), max_iters=(10, 50), hidden_sizes=[(8,)])
    return spark.createDataFrame(rows, "hidden string, reg_param double, max_iter int, val_auc double")
