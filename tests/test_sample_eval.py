import random

from pyspark.sql import functions as F

from fedsight.functions.rank import ordered_index, ranked
from fedsight.operators import evaluate as ev
from fedsight.operators import sample as sp


def test_class_weight_golden(spark):
    df = spark.range(16998 + 1874).withColumn("label", (F.col("id") < 1874).cast("int"))
    w = {r["label"]: r["weight"] for r in sp.class_weights(df, "label").collect()}
    # logged values are float32 prints
    assert abs(w[0] - 0.5551241) < 1e-6 and abs(w[1] - 5.0352187) < 1e-6


def test_stratified_split_golden(spark):
    df = spark.range(23591).withColumn("label", (F.col("id") < 2342).cast("int"))
    s = sp.stratified_split(df, "label", ["id"], 0.2)
    c = {(r["split"], r["label"]): r["count"] for r in s.groupBy("split", "label").count().collect()}
    assert c[("test", 0)] + c[("test", 1)] == 4719
    assert c[("train", 0)] + c[("train", 1)] == 18872
    assert c[("test", 1)] == 468 and c[("train", 1)] == 1874


def test_stratified_subsample_exact(spark):
    df = spark.range(58976).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    s = sp.stratified_subsample(df, "label", 0.4, ["id"])
    c = {r["label"]: r["count"] for r in s.groupBy("label").count().collect()}
    assert c[1] == round(5898 * 0.4) and c[0] == round(53078 * 0.4)


def test_two_level_rank_matches_row_number(spark):
    from pyspark.sql import Window
    from fedsight.functions.draws import uniform
    df = spark.range(5000).withColumn("g", (F.col("id") % 3).cast("int")).withColumn("u", uniform("id"))
    a = ranked(df, "u", ["g"], ["id"], buckets=16).select("id", "rank")
    b = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("u", "id")).alias("rank"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_partition_clients_contiguous(spark):
    df = spark.range(1000)
    out = sp.partition_clients(df, ["id"], 3)
    shares = sp.client_shares(3)
    rows = out.groupBy("client_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).collect()
    r = {x["client_id"]: x for x in rows}
    assert r["client_1"]["n"] == int(1000 * shares[0]) and r["client_1"]["lo"] == 0
    assert r["client_2"]["lo"] == r["client_1"]["hi"] + 1
    assert sum(x["n"] for x in rows) == 1000


def test_overlapping_clients(spark):
    out = sp.overlapping_clients(spark.range(100), ["id"], 3, 50)
    c = {r["client_id"]: r["n"] for r in out.groupBy("client_id").agg(F.countDistinct("id").alias("n")).collect()}
    assert c == {"client_1": 50, "client_2": 50, "client_3": 50}


def test_confusion_report_golden(spark):
    rows = [(0, 0)] * 4131 + [(0, 1)] * 120 + [(1, 0)] * 313 + [(1, 1)] * 155
    df = spark.createDataFrame(rows, "label int, pred int")
    cm = {(r["actual"], r["predicted"]): r["n"] for r in ev.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 4131, (0, 1): 120, (1, 0): 313, (1, 1): 155}
    rep = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert round(rep["1"]["precision"], 2) == 0.56 and round(rep["1"]["recall"], 2) == 0.33
    assert round(rep["1"]["f1"], 2) == 0.42 and round(rep["accuracy"]["f1"], 2) == 0.91
    assert round(rep["macro avg"]["f1"], 2) == 0.68 and round(rep["weighted avg"]["f1"], 2) == 0.90


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_vs_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(400)] + [(1, 1.0), (0, 0.0)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = ev.roc_auc(df, buckets=4).first()["auc"]
    assert abs(got - _brute_auc(rows)) < 1e-12
    single = spark.createDataFrame([(1, 0.3), (1, 0.4)], "label int, score double")
    assert ev.roc_auc(single).first()["auc"] is None


def test_contribution_closed_form(spark):
    aucs = [(1, 0.8), (3, None), (4, 0.6)]
    s = 1.0
    for _, a in aucs:
        s = 0.7 * s + 0.3 * (0.5 if a is None else a)
    df = spark.createDataFrame([("c", r, a) for r, a in aucs], "client_id string, round int, auc double")
    r = ev.contribution_scores(df).first()
    assert abs(r["contribution_score"] - s) < 1e-12 and r["last_update"] == 4


def test_positions_with_one_value_in_most_rows(spark):
    rnd = random.Random(3)
    rows = [(None if rnd.random() < 0.02 else "same" if rnd.random() < 0.9 else f"k{rnd.randint(0, 50):02d}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, id long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    at = {r: i for i, r in enumerate(order)}
    got = ordered_index(df, ["k", "id"], "at", partitions=16, size_col="n")
    assert {(r["k"], r["id"]): r["at"] for r in got.collect()} == at and {r["n"] for r in got.select("n").distinct().collect()} == {4000}
    # The value that most rows share is spread over the partitions.
    sizes = [r["count"] for r in df.repartitionByRange(16, "k", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1000
    held = sp.validation_holdout(df, ["k", "id"], 0.25)
    assert {(r["k"], r["id"]): r["is_validation"] for r in held.collect()} == {r: i >= 3000 for r, i in at.items()}
    parts = sp.partition_clients(df, ["k", "id"], 3, shares=[0.5, 0.3, 0.2])
    assert {(r["k"], r["id"]): r["client_id"] for r in parts.collect()} == {r: f"client_{1 + (i >= 2000) + (i >= 3200)}" for r, i in at.items()}
    assert sp.validation_holdout(df.limit(0), ["k", "id"]).count() == 0


def test_auc_paths(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), rnd.random() ** 4) for _ in range(500)]
    s = spark.createDataFrame(rows, "label int, score double")
    assert abs(ev.roc_auc(s, buckets=16).first()["auc"] - _brute_auc(rows)) < 1e-12
    assert abs(ev.roc_auc(s).first()["auc"] - _brute_auc(rows)) < 1e-12


def test_auc_with_one_score_in_most_rows(spark):
    import random
    from fedsight.operators import evaluate as ev
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), 0.5 if rnd.random() < 0.9 else round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(3000)]
    rows.append(("one class", 0.1, 1))
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {r["g"]: r["auc"] for r in ev.roc_auc(df, by=["g"]).collect()}
    for g in ("a", "b", None):
        pos = [s for x, s, y in rows if x == g and y == 1]
        neg = [s for x, s, y in rows if x == g and y == 0]
        u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert abs(got[g] - u / (len(pos) * len(neg))) < 1e-12
    assert got["one class"] is None
    assert ev.roc_auc(df.limit(0), by=["g"]).count() == 0
