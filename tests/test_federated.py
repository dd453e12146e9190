"""The resumable federated loop with explanation rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedsight.operators import aggregate as ag
from fedsight.operators import federated as fd
from fedsight.operators import perceptron as pc
from tests.test_perceptron import FEATS, data

NAMES = ("weights", "client_metrics", "global_metrics", "importance", "aggregated", "agreement")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(made, name):
    df = made.table(name)
    return None if df is None else sorted((tuple(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.asDict().items())) for r in df.collect()), key=repr)


def go(df, path, rounds, **more):
    more = {"explain": fd.Explanations(rounds=(1, 3), per_client=4, background=8, nsamples=16, aggregation="weighted")} | more
    return fd.train(df, FEATS, "id", pc.initial([3, 4, 1], 9), rounds, str(path), local_epochs=2, lr=0.3, test=df, **more)


def test_killed_run_resumes_to_the_same_result(spark, tmp_path, monkeypatch):
    df, X, y, who = data(spark, 200, hot=0.5)
    whole = go(df, tmp_path / "a", 3)
    with monkeypatch.context() as m:
        calls, plain = [], pc.average_tensors
        m.setattr(pc, "average_tensors", lambda *a, **k: calls.append(1) or (plain(*a, **k) if len(calls) < 3 else 1 / 0))
        with pytest.raises(ZeroDivisionError):
            go(df, tmp_path / "b", 3)                              # dies in round 3, with tables of it written
    made = fd.Rounds(spark, str(tmp_path / "b"))
    assert [m["round"] for m in made.done()] == [1, 2]
    made = go(df, tmp_path / "b", 3)
    assert [m["round"] for m in made.done()] == [1, 2, 3]
    for name in NAMES:
        assert rows_of(made, name) == rows_of(whole, name) and rows_of(made, name), name
    assert {r["round"] for r in made.table("importance").select("round").distinct().collect()} == {1, 3}
    assert sorted(map(tuple, made.contributions().collect())) == sorted(map(tuple, whole.contributions().collect()))
    log = made.log().collect()
    assert [r["round"] for r in sorted(log)] == [1, 2, 3] and all(r["seconds"] >= 0 and 0 <= r["auc"] <= 1 for r in log)
    # What the rounds carry on: decayed importances are those of the aggregated rounds.
    want = ag.temporal_decay(made.table("aggregated").select("round", "method", "feature", "value"))
    assert sorted(map(tuple, made.importances().collect())) == sorted(map(tuple, want.collect()))
    # Rounds that are there are not done again; other settings are refused.
    assert go(df, tmp_path / "b", 2).done() == made.done()
    with pytest.raises(ValueError, match="other settings"):
        go(df, tmp_path / "b", 4, weighted=True)


def test_rounds_equal_numpy_and_blocks(spark, tmp_path, monkeypatch):
    df, X, y, who = data(spark, 150, hot=0.4)
    net = pc.initial([3, 4, 1], 9)
    made = go(df, tmp_path / "a", 2, explain=None)
    for _ in range(2):
        nets = []
        for k in sorted(set(who)):
            own, n = who == k, net
            c = np.array([own.sum() / (len(set(y[own])) * (y[own] == v).sum()) for v in y[own]])
            for _ in range(2):
                n = n.shaped(n.flat() - 0.3 * n.sums(X[own], y[own].astype(float), c)[:n.size] / own.sum())
            nets.append(n.flat())
        net = net.shaped(np.mean(nets, axis=0))
    assert np.allclose(made.net().flat(), net.flat(), atol=1e-9)
    assert made.importances() is None and made.table("agreement") is None
    monkeypatch.setattr(pc, "MAX_NET_BYTES", 8 * (net.size + pc.N_SUMS))
    split = go(df, tmp_path / "b", 2, explain=None)
    assert np.allclose(split.net().flat(), net.flat(), atol=1e-9)
    assert rows_of(split, "client_metrics") == rows_of(made, "client_metrics")


def test_importances_explain_each_client_with_its_own_net(spark, tmp_path):
    df, *_ = data(spark, 120, hot=0.5)
    made = go(df, tmp_path / "a", 1, explain=fd.Explanations(per_client=3, background=5, nsamples=64, min_clients=99), min_clients=2)
    assert made.table("aggregated").count() == 0                    # the gate
    imp = made.table("importance")
    sums = imp.groupBy("client_id").agg(F.sum("value").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == df.select("client_id").distinct().count() and all(abs(r["s"] - 1) < 1e-9 and r["n"] == 3 for r in sums)
    noisy = go(df, tmp_path / "b", 1, explain=fd.Explanations(per_client=3, background=5, nsamples=16, epsilon=1.0)).table("importance")
    assert noisy.count() == imp.count()
    with pytest.raises(ValueError, match="min_clients"):
        go(df.where("client_id = 'c0'"), tmp_path / "c", 1)
    with pytest.raises(ValueError, match="aggregation"):
        go(df, tmp_path / "d", 1, explain=fd.Explanations(aggregation="mode"))
