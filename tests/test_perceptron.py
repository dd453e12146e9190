"""Perceptrons: gradients against differences and NumPy, stop, blocks of clients, averaging, contracts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedsight.operators import explain as ex
from fedsight.operators import perceptron as pc

FEATS = ["a", "b", "c"]


def data(spark, n=240, seed=3, hot=0.8):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    y = (np.abs(X[:, 0]) + X[:, 1] > 0.8).astype(int)           # not linear in a
    who = np.where(rng.random(n) < hot, 0, rng.integers(1, 4, n))
    df = spark.createDataFrame([(i, f"c{who[i]}", int(y[i]), *map(float, X[i])) for i in range(n)],
                               "id long, client_id string, label int, a double, b double, c double")
    return df.repartition(5), X, y, who


def balanced(y):
    return np.array([len(y) / (len(set(y)) * (y == v).sum()) for v in y])


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    net, X, y, c = pc.initial([3, 4, 2, 1], 1), rng.normal(size=(30, 3)), rng.integers(0, 2, 30).astype(float), rng.random(30)
    net = net.shaped(net.flat() + rng.normal(size=net.size) * .1)
    g, w = net.sums(X, y, c)[:net.size], net.flat()
    for i in range(net.size):
        e = np.zeros(net.size)
        e[i] = 1e-6
        up, down = (net.shaped(w + s * e).sums(X, y, c, False)[net.size + 1] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5
    assert (net.sums(X, y, c, False)[:net.size] == 0).all()


def test_distributed_steps_equal_numpy(spark):
    df, X, y, who = data(spark)
    start = pc.initial([3, 5, 1], 2)
    local = pc.local_train(pc.prepared(df, FEATS, "label", "client_id"), start, local_epochs=3, lr=0.2, l2=0.05)
    assert set(local.nets) == {f"c{k}" for k in set(who)}
    for k in set(who):
        own, net = who == k, start
        c = balanced(y[own])
        for _ in range(3):
            g = net.sums(X[own], y[own].astype(float), c)[:net.size] / own.sum()
            net = net.shaped(net.flat() - 0.2 * (g + 0.05 * net.penalty()))
        assert np.allclose(local.nets[f"c{k}"].flat(), net.flat(), atol=1e-10) and local.sizes[f"c{k}"] == own.sum()


def test_clients_in_blocks_and_small_flushes(spark, monkeypatch):
    df, *_ = data(spark, 120, hot=0.3)
    rows, start = pc.prepared(df, FEATS, "label", "client_id"), pc.initial([3, 5, 1], 2)
    whole = pc.local_train(rows, start, 2, 0.2)
    monkeypatch.setattr(pc, "MAX_NET_BYTES", 2 * 8 * (start.size + pc.N_SUMS))
    parts = pc.local_train(rows, start, 2, 0.2)
    assert set(parts.nets) == set(whole.nets) and parts.sizes == whole.sizes
    assert all(np.allclose(parts.nets[k].flat(), whole.nets[k].flat()) for k in whole.nets)


def test_fit_learns_stops_and_keeps_the_best(spark):
    df, X, y, _ = data(spark, 400)
    done = pc.fit(df, FEATS, ["id"], hidden=(8, 4), epochs=120, lr=0.05, patience=15)
    losses = [r[2] for r in done.log]
    assert done.best_epoch == 1 + int(np.argmin(losses)) and len(losses) <= max(done.best_epoch + 15, 120)
    assert ((done.net.probability(X) > 0.5) == y).mean() > 0.9
    held = np.arange(400) >= 320
    margin = np.log(done.net.probability(X[held]) / (1 - done.net.probability(X[held])))
    assert abs((np.logaddexp(0, margin) - y[held] * margin).mean() - min(losses)) < 1e-6
    assert done.log_table(spark).where("seconds >= 0").count() == len(losses)
    early = pc.fit(df, FEATS, ["id"], hidden=(2,), epochs=50, lr=5.0, patience=3, optimiser="sgd")
    assert len(early.log) < 50 and len(early.log) == early.best_epoch + 3
    plain = pc.fit(df, FEATS, ["id"], hidden=(2,), epochs=2, validation=0, class_weighted=False)
    assert [r[2] for r in plain.log] == [None, None]


def test_bad_rows_are_errors(spark):
    df, *_ = data(spark, 20)
    net = pc.initial([3, 2, 1])
    with pytest.raises(ValueError):
        pc.score_batch(df, FEATS[:2], net)
    for bad in (F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("inf"))):
        odd = df.withColumn("a", F.when(F.col("id") == 3, bad).otherwise(F.col("a")))
        with pytest.raises(Exception, match="null, NaN or infinite"):
            pc.score_batch(odd, FEATS, net).collect()
        with pytest.raises(Exception, match="null, NaN or infinite"):
            pc.fit(odd, FEATS, ["id"], epochs=1)
    with pytest.raises(Exception, match="one probability a row"):
        pc.score_batch(df, FEATS, lambda X: X[:, 0] * 100).collect()
    with pytest.raises(ValueError):
        pc.fit(df.limit(0), FEATS, ["id"], epochs=1)
    assert pc.score_batch(df.limit(0), FEATS, net).count() == 0


def test_scores_of_net_and_of_fitted_models(spark):
    df, X, *_ = data(spark, 50)
    net = pc.initial([3, 4, 1], 5)
    got = {r.id: r for r in pc.score_batch(df, FEATS, net, 0.4).collect()}
    assert np.allclose([got[i].prob_1 for i in range(50)], net.probability(X))
    assert all(r.pred == int(r.prob_1 > 0.4) and abs(r.prob_0 + r.prob_1 - 1) < 1e-12 for r in got.values())
    linear = ex.linear_scorer([1.0, -2.0, 0.5], 0.1)
    assert np.allclose([r.prob_1 for r in pc.score_batch(df, FEATS, linear).orderBy("id").collect()], linear(X))
    phi = ex.kernel_shap_batch(df.limit(2), df.limit(10), FEATS, "id", exact=True, scorer=net.probability)
    assert phi.count() == 6


def test_average_and_tables(spark):
    nets = {"x": pc.initial([3, 2, 1], 1), "y": pc.initial([3, 2, 1], 2)}
    long = pc.long_table(spark, nets, sizes={"x": 3, "y": 1})
    assert np.allclose(pc.net_of(pc.average_tensors(long)).flat(), (nets["x"].flat() + nets["y"].flat()) / 2)
    assert np.allclose(pc.net_of(pc.average_tensors(long, weighted=True)).flat(), (3 * nets["x"].flat() + nets["y"].flat()) / 4)
    both = pc.average_tensors(long.withColumn("round", F.lit(1)).unionByName(long.withColumn("round", F.lit(2))), by=["round"])
    assert both.groupBy("round").count().collect() == [(1, 11), (2, 11)] or both.count() == 22
    assert np.allclose(pc.net_of(pc.long_table(spark, nets["x"])).flat(), nets["x"].flat())
    odd = long.unionByName(pc.long_table(spark, {"z": pc.initial([3, 4, 1])}, sizes={"z": 1}))
    with pytest.raises(Exception, match="differ in shape"):
        pc.average_tensors(odd).collect()
    with pytest.raises(ValueError):
        pc.net_of(long.where("false"))
    imp = {r.row: r.importance for r in pc.input_importance(pc.long_table(spark, nets["x"]), 3).collect()}
    assert np.allclose([imp[i] for i in range(3)], np.abs(nets["x"].tensors[0][:-1]).mean(axis=1))
