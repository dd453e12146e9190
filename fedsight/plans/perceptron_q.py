"""Queries for perceptrons (F2, F4-F6, F8, G10) on the embedding rows: 64
features, three rectified units, one output, from fixed start weights so that
SQL can write every step out."""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from fedsight.operators import federated as fd
from fedsight.operators import perceptron as pc
from fedsight.plans.registry import query
from fedsight.session import ensure_checkpoint_dir
from fedsight.sources import testbed as tb

D, H, LR, L2 = tb.N_EMB_FEATURES, 3, 0.5, 0.01
FEATS = [f"f{i}" for i in range(D)]
#: Fixed start weights, biases in the last row.
FIRST = [[round(0.2 * math.sin(1 + 3 * i + j), 6) for j in range(H)] for i in range(D + 1)]
SECOND = [[round(0.5 * math.cos(2 + j), 6)] for j in range(H + 1)]
START = pc.Net((np.array(FIRST), np.array(SECOND)))

ROWS = tb.with_ctes(tb.sql_training_rows(D))
#: Weights as columns: a{i}_{j} of the first layer, v{j} of the second.
CELLS = [(0, i, j, f"a{i}_{j}", FIRST[i][j]) for i in range(D + 1) for j in range(H)] + [(1, j, 0, f"v{j}", SECOND[j][0]) for j in range(H + 1)]
_START = ", ".join(f"{x!r} AS {name}" for *_, name, x in CELLS)


def _forward(rows: str, w: str) -> str:
    z = ", ".join(" + ".join(f"t.f{i} * W.a{i}_{j}" for i in range(D)) + f" + W.a{D}_{j} AS z{j}" for j in range(H))
    v = ", ".join(f"W.v{j}" for j in range(H + 1))
    margin = " + ".join(f"greatest(z{j}, 0) * v{j}" for j in range(H)) + f" + v{H}"
    return f"""SELECT *, 1.0 / (1.0 + exp(-m)) AS p FROM (SELECT *, {margin} AS m FROM (
        SELECT t.*, {v}, {z} FROM {rows} t JOIN {w} W ON t.client_id = W.client_id) x) x"""


def sql_step(rows: str, w: str, out: str) -> str:
    """CTE ``out``: one class-weighted full-batch step per client of ``rows``
    (client_id, label, c, f0...) from the weights CTE ``w``."""
    grads = [f"sum(c * (p - label) * v{j} * (z{j} > 0)::INTEGER * {f'f{i}' if i < D else '1.0'}) AS a{i}_{j}" for i in range(D + 1) for j in range(H)]
    grads += [f"sum(c * (p - label) * {f'greatest(z{j}, 0)' if j < H else '1.0'}) AS v{j}" for j in range(H + 1)]
    bias = {f"a{D}_{j}" for j in range(H)} | {f"v{H}"}
    step = ", ".join(f"W.{n} - {LR} * (g.{n} / g.n{'' if n in bias else f' + {L2} * W.{n}'}) AS {n}" for *_, n, _ in CELLS)
    return f"""{out}_f AS ({_forward(rows, w)}),
{out}_g AS (SELECT client_id, count(*) AS n, {', '.join(grads)} FROM {out}_f GROUP BY client_id),
{out} AS (SELECT g.client_id, g.n AS data_size, {step} FROM {out}_g g JOIN {w} W ON g.client_id = W.client_id)"""


def sql_long(w: str, by: str = "") -> str:
    by = f"{by}, " if by else ""
    return " UNION ALL ".join(f"SELECT {by}{layer} AS layer, {r} AS row, {c} AS col, round({n}, 6) AS value FROM {w}" for layer, r, c, n, _ in CELLS)


_WEIGHTED = """cnt AS (SELECT client_id, label, count(*) AS ny FROM training_rows GROUP BY client_id, label),
tot AS (SELECT client_id, sum(ny) AS n, count(*) AS k FROM cnt GROUP BY client_id),
cw AS (SELECT cnt.client_id, label, n / (k * ny) AS c FROM cnt JOIN tot ON cnt.client_id = tot.client_id),
rows_ AS (SELECT t.*, cw.c FROM training_rows t JOIN cw ON t.client_id = cw.client_id AND t.label = cw.label),
w0_ AS (SELECT DISTINCT client_id, """ + _START + " FROM training_rows)"
_TWO = ROWS + ",\n" + _WEIGHTED + ",\n" + sql_step("rows_", "w0_", "w1_") + ",\n" + sql_step("rows_", "w1_", "w2_")
_AVERAGE = ("avg_ AS (SELECT " + ", ".join(f"sum({n} * data_size) / sum(data_size) AS {n}" for *_, n, _ in CELLS) + " FROM w2_)")


def _local(spark, d):
    return pc.local_train(pc.prepared(tb.training_rows(spark, d, D), FEATS, "label", "client_id"), START, local_epochs=2, lr=LR, l2=L2)


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


# two local epochs per client.
@query("perceptron_local_train", _TWO + "\n" + sql_long("w2_", "client_id"))
def q_local(spark, d):
    return _rounded(_local(spark, d).table(spark).drop("data_size"))


# average of both layers over the clients, weighted by their rows.
@query("perceptron_average", _TWO + ",\n" + _AVERAGE + "\n" + sql_long("avg_"))
def q_average(spark, d):
    return _rounded(pc.average_tensors(_local(spark, d).table(spark), weighted=True))


# F8: importance of the averaged net's inputs.
@query("perceptron_importance", _TWO + ",\n" + _AVERAGE + "\n" + " UNION ALL ".join(
    f"SELECT {i} AS row, round(({' + '.join(f'abs(a{i}_{j})' for j in range(H))}) / {H}, 6) AS importance FROM avg_" for i in range(D)))
def q_importance(spark, d):
    avg = pc.average_tensors(_local(spark, d).table(spark), weighted=True)
    return pc.input_importance(avg, D).withColumn("importance", F.round("importance", 6))


# probabilities of a fixed net.
@query("score_perceptron", ROWS + ", w0_ AS (SELECT DISTINCT client_id, " + _START + f""" FROM training_rows)
SELECT vec_id, client_id, label, round(p, 9) AS prob_1, round(1.0 - p, 9) AS prob_0, CAST(p > 0.5 AS INTEGER) AS pred
FROM ({_forward("training_rows", "w0_")}) x""")
def q_score(spark, d):
    out = pc.score_batch(tb.training_rows(spark, d, D), FEATS, START)
    return out.select("vec_id", "client_id", "label", F.round("prob_1", 9).alias("prob_1"), F.round("prob_0", 9).alias("prob_0"), "pred")


# Log of a central fit over three epochs, the last fifth of the rows held out.
_PARTS = """cnt AS (SELECT label, count(*) AS ny FROM training_rows GROUP BY label),
cw AS (SELECT label, (SELECT sum(ny) FROM cnt) / ((SELECT count(*) FROM cnt) * ny) AS c FROM cnt),
all_ AS (SELECT t.* EXCLUDE client_id, 'all' AS client_id, cw.c, row_number() OVER (ORDER BY vec_id) > floor((count(*) OVER ()) * (1 - 0.2)) AS held
    FROM training_rows t JOIN cw ON t.label = cw.label),
rows_ AS (SELECT * FROM all_ WHERE NOT held),
w0_ AS (SELECT 'all' AS client_id, """ + _START + ")"


def _epoch(e: int) -> str:
    ce = "(CASE WHEN m > 0 THEN m + ln(1 + exp(-m)) ELSE ln(1 + exp(m)) END - label * m)"
    ok = "CAST((p > 0.5) = (label = 1) AS DOUBLE)"
    return f"""SELECT {e + 1} AS epoch, round(sum(CASE WHEN NOT held THEN c * {ce} END) / count(*) FILTER (WHERE NOT held), 6) AS train_loss,
    round(avg({ce}) FILTER (WHERE held), 6) AS validation_loss, round(avg({ok}) FILTER (WHERE NOT held), 6) AS train_accuracy,
    round(avg({ok}) FILTER (WHERE held), 6) AS validation_accuracy FROM ({_forward("all_", f"w{e}_")}) x"""


@query("perceptron_training_log", ROWS + ",\n" + _PARTS + ",\n" + sql_step("rows_", "w0_", "w1_") + ",\n" + sql_step("rows_", "w1_", "w2_")
       + "\n" + " UNION ALL ".join(_epoch(e) for e in range(3)))
def q_log(spark, d):
    fit = pc.fit(tb.training_rows(spark, d, D), FEATS, ["vec_id"], epochs=3, lr=LR, l2=L2, optimiser="sgd", start=START)
    values = ["train_loss", "validation_loss", "train_accuracy", "validation_accuracy"]
    return fit.log_table(spark).select("epoch", *[F.round(c, 6).alias(c) for c in values])


# a central fit with Adam and the validation stop; metrics of all rows per client.
@query("perceptron_fit")
def q_fit(spark, d):
    from fedsight.operators import evaluate as ev
    rows = tb.training_rows(spark, d, D)
    net = pc.fit(rows, FEATS, ["vec_id"], hidden=(16, 8), epochs=25, patience=5).net
    return ev.metrics(pc.score_batch(rows, FEATS, net).withColumnRenamed("prob_1", "score"), ["client_id"])


# the global net after each of two rounds: all clients, one local epoch, plain average.
_MEAN = "{out} AS (SELECT " + ", ".join(f"avg({n}) AS {n}" for *_, n, _ in CELLS) + " FROM {w})"
_SPREAD = "{out} AS (SELECT c.client_id, g.* FROM (SELECT DISTINCT client_id FROM training_rows) c, {w} g)"


def _folder(spark) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"rounds-{uuid.uuid4().hex}")


@query("perceptron_rounds", ROWS + ",\n" + _WEIGHTED + ",\n" + sql_step("rows_", "w0_", "l1_") + ",\n" + _MEAN.format(out="g1_", w="l1_") + ",\n"
       + _SPREAD.format(out="s1_", w="g1_") + ",\n" + sql_step("rows_", "s1_", "l2_") + ",\n" + _MEAN.format(out="g2_", w="l2_") + "\n"
       + sql_long("g1_", "1 AS round") + " UNION ALL " + sql_long("g2_", "2 AS round"))
def q_rounds(spark, d):
    made = fd.train(tb.training_rows(spark, d, D), FEATS, "vec_id", START, 2, _folder(spark), lr=LR, l2=L2)
    return _rounded(made.table("weights"))


# F7 with explanation rounds: decayed importances after two rounds.
@query("federated_explained")
def q_explained(spark, d):
    e = fd.Explanations(per_client=5, background=20, nsamples=128)
    made = fd.train(tb.training_rows(spark, d, D), FEATS, "vec_id", START, 2, _folder(spark), lr=LR, l2=L2, explain=e)
    return made.importances()
