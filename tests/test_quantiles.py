import random

import numpy as np

from fedsight.functions.quantiles import quantile_values


def test_equals_linear_interpolation(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(30000):
        a = rnd.gauss(0, 1)
        b = float(rnd.randint(0, 50))            # many duplicates
        c = rnd.choice([float("nan"), float("inf"), None, rnd.random()])
        hot = 7.5 if rnd.random() < 0.9 else rnd.random() * 100   # one value in 90 % of the rows
        rows.append((a, b, c, hot))
    rows.append((1e12, 0.0, 0.5, -3.0))          # extreme outlier
    df = spark.createDataFrame(rows, "a double, b double, c double, hot double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    got = quantile_values(df, ["a", "b", "c", "hot"], probs)
    for j, col in enumerate(["a", "b", "c", "hot"]):
        x = np.array([r[j] for r in rows if r[j] is not None and np.isfinite(r[j])])
        for p in probs:
            assert abs(got[(col, p)] - np.quantile(x, p)) <= 1e-9 * max(1, abs(got[(col, p)])), (col, p)


def test_empty_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 3.0)], "x double, y double")
    assert quantile_values(df, ["x", "y"], [0.5]) == {("x", 0.5): None, ("y", 0.5): 2.0}
    assert quantile_values(df.limit(0), ["x"], [0.5]) == {("x", 0.5): None}


def test_result_does_not_depend_on_the_sketch(spark):
    """A sketch of two ranks puts the cut points anywhere; ties at cut points, few values, hot inner values."""
    rnd = random.Random(4)
    rows = [(float(rnd.randint(0, 9)), 3.25 if rnd.random() < 0.6 else rnd.gauss(0, 1), float(i % 2), -0.0 if i % 3 else 5e-324) for i in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    for probs in ([0.5], [0.0, 0.25, 0.4999, 0.5, 0.75, 1.0]):
        for accuracy in (2, 40, 1000):
            got = quantile_values(df, ["a", "b", "c", "d"], probs, accuracy=accuracy)
            for j, col in enumerate("abcd"):
                for p in probs:
                    assert got[(col, p)] == np.quantile([r[j] for r in rows], p) or abs(got[(col, p)] - np.quantile([r[j] for r in rows], p)) < 1e-12, (col, p, accuracy)


def test_single_value_and_no_columns(spark):
    df = spark.createDataFrame([(7.0,)], "x double")
    assert quantile_values(df, ["x"], [0.0, 0.3, 1.0]) == {("x", 0.0): 7.0, ("x", 0.3): 7.0, ("x", 1.0): 7.0}
    assert quantile_values(df, [], [0.5]) == {}


def test_only_values_near_a_quantile_are_shuffled(spark):
    """The candidates that are counted by value are a small share of the cells."""
    import fedsight.functions.quantiles as q
    df = spark.range(200_000).selectExpr(*[f"xxhash64(id, {i}) / 1e9 AS x{i}" for i in range(64)])
    seen, plain = [], q._at_ranks
    q._at_ranks = lambda values, wanted: seen.append(values.agg({"n": "sum"}).first()[0]) or plain(values, wanted)
    try:
        quantile_values(df, df.columns, [0.25, 0.5, 0.75])
    finally:
        q._at_ranks = plain
    assert sum(seen) < 0.05 * 200_000 * 64
