import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedsight.operators import explain as ex
from fedsight.operators import train as tr

FEATS = ["a", "b", "c", "d"]
W = [1.5, -2.0, 0.5, 0.0]
B = -0.2


def _rows(spark, n=200, seed=1):
    rnd = np.random.default_rng(seed)
    X = rnd.normal(size=(n, 4))
    y = (X @ np.array(W) + B + rnd.normal(scale=0.5, size=n) > 0).astype(int)
    return spark.createDataFrame([(i, f"c{i % 3}", int(y[i]), *map(float, X[i])) for i in range(n)],
                                 "id long, client_id string, label int, a double, b double, c double, d double")


def _f(x):
    return 1.0 / (1.0 + math.exp(-(sum(w * v for w, v in zip(W, x)) + B)))


def test_kernel_shap_equals_exact_shapley(spark):
    rows = _rows(spark)
    inst = rows.limit(3)
    bg = rows.orderBy("id").limit(20)
    phi = ex.kernel_shap_batch(inst, bg, FEATS, "id", W, B, exact=True)
    got = {}
    for r in phi.collect():
        got.setdefault(r["id"], {})[r["feature"]] = (r["phi"], r["base_value"], r["prediction"])
    bgx = [[r[f] for f in FEATS] for r in bg.collect()]
    for r in inst.collect():
        x = [r[f] for f in FEATS]

        def v(S):
            return np.mean([_f([x[j] if j in S else b[j] for j in range(4)]) for b in bgx])
        for j in range(4):
            others = [k for k in range(4) if k != j]
            sh = 0.0
            for s in range(4):
                for S in itertools.combinations(others, s):
                    wgt = math.factorial(s) * math.factorial(4 - s - 1) / math.factorial(4)
                    sh += wgt * (v(set(S) | {j}) - v(set(S)))
            assert abs(got[r["id"]][FEATS[j]][0] - sh) < 1e-9
        tot = sum(p for p, _, _ in got[r["id"]].values())
        base, pred = next(iter(got[r["id"]].values()))[1:]
        assert abs(tot - (pred - base)) < 1e-9   # additivity


def test_kernel_weight_golden():
    per_size = [math.comb(32, n) * w for n, w in enumerate(ex.kernel_size_weights(32))][1:32]
    left = 1 - (per_size[0] + per_size[-1]) / sum(per_size)
    assert abs(left - 0.74368134682094) < 1e-12


def test_kernel_shap_edges(spark):
    rows = _rows(spark)
    inst, bg = rows.limit(2), rows.orderBy("id").limit(10)
    one = ex.kernel_shap_batch(inst, bg, ["a"], "id", [2.0], 0.1).collect()
    assert len(one) == 2 and all(abs(r["phi"] - (r["prediction"] - r["base_value"])) < 1e-12 for r in one)
    few = ex.kernel_shap_batch(inst, bg, FEATS, "id", W, B, nsamples=2).groupBy("id").agg(
        F.sum("phi").alias("s"), F.first("prediction").alias("p"), F.first("base_value").alias("b")).collect()
    assert len(few) == 2 and all(abs(r["s"] - (r["p"] - r["b"])) < 1e-9 for r in few)
    for bad in (dict(features=[f"x{i}" for i in range(20)], weights=[1.0] * 20, exact=True), dict(features=FEATS, weights=None),
                dict(features=FEATS, weights=W, max_background=5)):
        try:
            wide = [F.lit(1.0).alias(f"x{i}") for i in range(20)]
            ex.kernel_shap_batch(inst.select("*", *wide), bg.select("*", *wide), key="id", bias=B, **bad)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_fitted_models_can_be_explained(spark):
    rows = _rows(spark, 300)
    for hidden in (None, [3]):
        model = tr.fit_classifier(rows, FEATS, hidden=hidden, max_iter=30, class_weighted=not hidden)
        f = ex.fitted_scorer(model)
        got = tr.predict(model, rows, FEATS).orderBy("id").select("score", *FEATS).collect()
        X = np.array([[r[c] for c in FEATS] for r in got])
        assert np.allclose(f(X), [r["score"] for r in got], atol=1e-9)
        phi = ex.kernel_shap_batch(rows.limit(2), rows.limit(10), FEATS, "id", scorer=f, exact=True).groupBy("id").agg(
            F.sum("phi").alias("s"), F.first("prediction").alias("p"), F.first("base_value").alias("b")).collect()
        assert all(abs(r["s"] - (r["p"] - r["b"])) < 1e-9 for r in phi)
        assert ex.lime_batch(rows.limit(2), rows, FEATS, "id", scorer=f, num_samples=200, max_features=2).count() == 4


def test_linear_shap_additivity(spark):
    rows = _rows(spark)
    phi = ex.linear_shap(rows, FEATS, "id", W, B, rows)
    s = phi.groupBy("id").agg(F.sum("phi").alias("s"), F.first("base_value").alias("base"))
    j = s.join(rows, "id").collect()
    for r in j:
        margin = sum(w * r[f] for w, f in zip(W, FEATS)) + B
        assert abs(r["s"] - (margin - r["base"])) < 1e-9


def test_lime_recovers_signs(spark):
    rows = _rows(spark, 400)
    cuts = {r["feature"]: (r["q1"], r["q3"]) for r in ex.quartile_cuts(rows, FEATS).collect()}
    inst = rows.limit(30)
    xs = {r["id"]: r for r in inst.collect()}
    out = ex.lime_batch(inst, rows, FEATS, "id", W, B, num_samples=800, max_features=4).collect()
    assert len(out) == 30 * 4
    checked = 0
    for r in out:
        # z = 1 means "in the instance's bin": in the top bin the weight has the model's sign, in the lowest the other
        x, (q1, q3) = xs[r["id"]][r["feature"]], cuts[r["feature"]]
        if r["feature"] in ("a", "b") and (x <= q1 or x > q3):
            side = 1 if x > q3 else -1
            assert r["weight"] * side * W[FEATS.index(r["feature"])] > 0
            checked += 1
    assert checked > 10


def test_lime_equals_weighted_ridge_on_its_own_draws(spark):
    """One feature: the surrogate is the weighted difference of two means, shrunk."""
    rows = _rows(spark, 100)
    out = ex.lime_batch(rows.limit(3), rows, ["a"], "id", [2.0], 0.0, num_samples=4000, max_features=1, alpha=0.0).collect()
    stats = {r["bin"]: r["m"] for r in ex.quartile_bins(rows, ["a"], "id", ex.quartile_cuts(rows, ["a"])).groupBy("bin").agg(
        F.avg("value").alias("m")).collect()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    cut = ex.quartile_cuts(rows, ["a"]).first()
    xs = {r["id"]: r["a"] for r in rows.collect()}
    for r in out:
        x = xs[r["id"]]
        b = sum(x > cut[q] for q in ("q1", "q2", "q3"))
        others = np.mean([sig(2 * stats[k]) for k in range(4) if k != b])
        assert abs(r["weight"] - (sig(2 * x) - others)) < 0.03


def test_local_epochs_grow_linearly(spark):
    rows = _rows(spark, 60)
    start = rows.select("client_id").distinct().select("client_id", tr.zero_model(4).alias("_w"), F.lit(0.0).alias("_b"))
    size = [str(tr.local_train(rows, FEATS, start, e, lr=0.5)._jdf.queryExecution().optimizedPlan()).count("Aggregate") for e in (2, 5)]
    assert size[0] == size[1]      # each epoch starts from checkpointed weights
    one = tr.local_train(rows, FEATS, start, 1, lr=0.5)
    two = tr.local_train(rows, FEATS, one, 1, lr=0.5).orderBy("client_id").collect()
    assert np.allclose([r["_w"] for r in two], [r["_w"] for r in tr.local_train(rows, FEATS, start, 2, lr=0.5).orderBy("client_id").collect()])


def test_fedavg_identical_clients_equals_central(spark):
    base = _rows(spark, 90).drop("client_id")
    rows = base.withColumn("client_id", F.lit("c1")).unionByName(base.withColumn("client_id", F.lit("c2")))
    one = base.withColumn("client_id", F.lit("central"))
    fed = tr.fedavg_train(rows, FEATS, rounds=2, lr=0.3, l2=0.0)
    cen = tr.fedavg_train(one, FEATS, rounds=2, lr=0.3, l2=0.0)
    a = fed.model.first()
    b = cen.model.first()
    assert np.allclose(a["_w"], b["_w"], atol=1e-12) and abs(a["_b"] - b["_b"]) < 1e-12


def test_local_step_matches_numpy(spark):
    rows = _rows(spark, 60)
    start = rows.select("client_id").distinct().select("client_id", tr.zero_model(4).alias("_w"), F.lit(0.0).alias("_b"))
    out = {r["client_id"]: r for r in tr.local_train(rows, FEATS, start, 1, lr=0.5, l2=0.1).collect()}
    data = rows.collect()
    for c in ("c0", "c1", "c2"):
        part = [r for r in data if r["client_id"] == c]
        X = np.array([[r[f] for f in FEATS] for r in part])
        y = np.array([r["label"] for r in part])
        n = len(y)
        k = len(set(y))
        cw = np.array([n / (k * (y == v).sum()) for v in y])
        g = (cw * (0.5 - y)) @ X / n
        assert np.allclose(out[c]["_w"], -0.5 * g, atol=1e-12)


def test_sampled_kernel_shap_additivity(spark):
    rows = _rows(spark)
    inst = rows.limit(2)
    bg = rows.orderBy("id").limit(10)
    phi = ex.kernel_shap_batch(inst, bg, FEATS, "id", W, B, nsamples=300)
    for r in phi.groupBy("id").agg(F.sum("phi").alias("s"), F.first("base_value").alias("b"),
                                   F.first("prediction").alias("p")).collect():
        assert abs(r["s"] - (r["p"] - r["b"])) < 1e-9
    # sampled values are close to the exact ones
    exact = {(r["id"], r["feature"]): r["phi"] for r in ex.kernel_shap_batch(inst, bg, FEATS, "id", W, B, exact=True).collect()}
    for r in phi.collect():
        assert abs(r["phi"] - exact[(r["id"], r["feature"])]) < 0.05


def test_importance_by_method_and_size(spark):
    rows = _rows(spark, 60)
    for method in ("shap", "lime"):
        got = ex.importance_by_method(rows, FEATS, "id", ex.linear_scorer(W, B), rows.limit(30), method, [2, 10, 1000], nsamples=60).collect()
        assert {(r["n_samples"], r["n_rows"]) for r in got} == {(2, 2), (10, 10), (1000, 60)} and len(got) == 12
        big = {r["feature"]: r["importance"] for r in got if r["n_samples"] == 1000}
        assert big["b"] > big["c"] > big["d"] and all(r["std_error"] >= 0 for r in got)
    try:
        ex.importance_by_method(rows, FEATS, "id", ex.linear_scorer(W, B), rows, "other")
        raise AssertionError("no error")
    except ValueError:
        pass


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_local_step_sorts_no_rows(spark):
    """The old weights pass through the aggregate as numbers, so it hashes instead of sorting every row by client."""
    rows = spark.createDataFrame([(f"c{i % 2}", i % 2 if i < 6 else 1, float(i), 1.0 - i) for i in range(9)], "client_id string, label int, a double, b double")
    start = spark.createDataFrame([("c0", [0.5, -1.0], 0.25), ("c1", [0.0, 2.0], -1.0)], "client_id string, _w array<double>, _b double")
    step = tr.local_step(rows, ["a", "b"], start, None, 0.3, 0.1, broadcast_weights=True)
    assert "SortAggregate" not in plan_of(step)
    got = {r.client_id: r for r in step.collect()}
    for c, w, b in (("c0", [0.5, -1.0], 0.25), ("c1", [0.0, 2.0], -1.0)):
        own = [r for r in rows.collect() if r.client_id == c]
        X, y = np.array([[r.a, r.b] for r in own]), np.array([r.label for r in own])
        e = 1 / (1 + np.exp(-(X @ np.array(w) + b))) - y
        assert np.allclose(got[c]._w, np.array(w) - 0.3 * (e @ X / len(own) + 0.1 * np.array(w))) and got[c].data_size == len(own)
        assert abs(got[c]._b - (b - 0.3 * e.mean())) < 1e-12


def test_federated_run_splits_once(spark, monkeypatch):
    """All passes over the parts read the written split; its ranks aren't computed again for each."""
    from fedsight.plans import runs_q

    def seen(df, cols, fit_on=None):
        raise ZeroDivisionError(plan_of(df))
    monkeypatch.setattr(runs_q.clean, "standardize", seen)
    with pytest.raises(ZeroDivisionError) as plan:
        runs_q.q_federated_run(spark, "/root/testdata/sf0.001")
    assert "ExistingRDD" in str(plan.value) and "Window" not in str(plan.value) and "Join" not in str(plan.value)
