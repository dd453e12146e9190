"""Concurrent settings (F3, L2) and checks of a table before it is committed."""

import threading

import pytest
from pyspark.sql import functions as F

from fedsight.functions.parallel import run_settings
from fedsight.operators import sweep as sw
from fedsight.operators import train as tr
from fedsight.sources import io


def test_settings_run_together_and_in_order(spark):
    meet = threading.Barrier(3, timeout=60)             # passes only if three settings run at once

    def run(n):
        meet.wait()
        return spark.range(n).count()

    assert run_settings(spark, [5, 3, 9], run, parallel=3) == [5, 3, 9]
    assert run_settings(spark, [5, 3, 9], lambda n: spark.range(n).count(), parallel=1) == [5, 3, 9]
    assert run_settings(spark, [], run) == []
    with pytest.raises(ValueError):
        run_settings(spark, [1], run, parallel=0)


def test_failed_setting_is_named_and_later_ones_are_not_run(spark):
    began = []

    def run(n):
        began.append(n)
        if n == 2:
            raise ValueError("no such value")
        return n

    with pytest.raises(RuntimeError, match=r"setting <2> failed: no such value"):
        run_settings(spark, [1, 2, 3, 4], run, parallel=1, name=lambda n: f"<{n}>")
    assert began[:2] == [1, 2]


def test_search_is_the_same_in_parallel(spark):
    df = spark.range(400).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b")).withColumn(
        "label", (F.col("a") + F.col("b") * 0.3 + F.sin(F.col("id") * 7) * 0.5 > 0).cast("int"))
    search = lambda p: tr.param_search(df, ["a", "b"], ["id"], reg_params=(0.0, 0.5), max_iters=(1, 20), hidden_sizes=[(3,)], parallel=p)
    (m1, one), (m4, four) = search(1), search(4)
    assert [r[:3] for r in one] == [r[:3] for r in four] and all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(one, four))
    assert type(m1) is type(m4)
    with pytest.raises(RuntimeError, match="reg_param=-1"):
        tr.param_search(df, ["a", "b"], ["id"], reg_params=(0.0, -1.0), max_iters=(5,))


def test_sweep_in_parallel(spark):
    configs = [{"name": "c", "n": 3}, {"name": "a", "n": 0}, {"name": "b", "n": 2}]
    got = sw.run_sweep(configs, lambda c: spark.range(int(c["n"])), parallel=3)
    assert sorted((r["experiment"], r["id"]) for r in got.collect()) == [("b", 0), ("b", 1), ("c", 0), ("c", 1), ("c", 2)]
    with pytest.raises(ValueError):
        sw.run_sweep([], lambda c: spark.range(1))


def test_counts_of_a_write(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, None, 1), (nan, 2.0, 0), (-inf, 3.0, 2), (inf, nan, None)], "a double, b double, y int")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    n = io.write_counted(df.repartition(3).mapInArrow(seen, df.schema).withColumnRenamed("b", "b.c"), str(tmp_path / "t"), ["a", "b.c"], "y")
    assert n == {"n_rows": 4, "null_0": 0, "nan_0": 1, "inf_0": 2, "null_1": 1, "nan_1": 1, "inf_1": 0, "bad_label": 2}
    assert read.value == 4                              # the source is computed once
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert io.write_counted(df.limit(0), str(tmp_path / "e"), ["a"])["n_rows"] == 0


def test_training_table_is_committed_only_if_it_keeps_its_contract(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2, 0), (2.0, 3, 1)], "a double, b int, y int")
    path = str(tmp_path / "good")
    assert io.write_training_table(df, path, ["a", "b"], "y", width=2).count() == 2
    with pytest.raises(ValueError, match="another table"):
        io.write_training_table(df, path, ["a", "b"], "y")
    assert io.read_committed(spark, path).count() == 2
    breaches = {"width": (df, ["a"], "y", 2, "takes 2 features"), "null": (df.withColumn("a", F.lit(None).cast("double")), ["a"], "y", 1, "2 null"),
                "nan": (df.withColumn("a", F.lit(float("nan"))), ["a"], "y", None, "2 NaN"),
                "inf": (df.withColumn("a", F.lit(float("-inf"))), ["a"], "y", None, "2 infinite"),
                "label": (df.withColumn("y", F.lit(7)), ["a"], "y", None, "label other than"), "empty": (df.limit(0), ["a"], "y", None, "no rows"),
                "names": (df, ["a", "zz"], "y", None, "missing"), "twice": (df, ["a", "a"], "y", None, "twice"), "type": (df.withColumn("a", F.lit("x")), ["a"], "y", None, "not numbers")}
    for name, (frame, features, label, width, says) in breaches.items():
        with pytest.raises(ValueError, match=says):
            io.write_training_table(frame, str(tmp_path / name), features, label, width)
        assert not (tmp_path / name / "COMMITTED").exists()
