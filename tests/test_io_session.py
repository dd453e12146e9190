from pyspark.sql import functions as F

from fedsight.session import checkpoint_dir, cut_lineage
from fedsight.sources import io


def test_checkpoint_uses_session_folder(spark):
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext._jsc.sc().getCheckpointDir().get().startswith(("file:" + d, d))
    assert cut_lineage(spark.range(5)).count() == 5


def test_history_latest_run_and_round_keys(spark):
    path = io.fresh_path(spark, "hist-test")
    g1 = spark.createDataFrame([(1, "lime", "a", 0.1), (2, "lime", "a", 0.2)], "round int, method string, feature string, value double")
    g2 = g1.withColumn("value", F.col("value") * 10)
    io.write_history_json(g1, path, "run-0001")
    io.write_history_json(g2, path, "run-0002")
    got = sorted((r["round"], r["value"]) for r in io.read_history_json(spark, path).collect())
    assert got == [(1, 1.0), (2, 2.0)]
    old = sorted((r["round"], r["value"]) for r in io.read_history_json(spark, path, "run-0001").collect())
    assert old == [(1, 0.1), (2, 0.2)]


def test_summaries_roundtrip(spark):
    imp = spark.createDataFrame([("c1", 1, "lime", "a", 0.5), ("c1", 1, "shap", "b", -0.25), ("c2", 2, "lime", "a", 1.0)],
                                "client_id string, round int, method string, feature string, value double")
    path = io.fresh_path(spark, "sum-test")
    io.write_summaries_json(io.nest_summaries(imp), path)
    back = io.unnest_summaries(io.read_summaries_json(spark, path))
    assert sorted(map(tuple, back.select(*imp.columns).collect())) == sorted(map(tuple, imp.collect()))


def test_cache_commits_one_builder(spark, tmp_path):
    from fedsight.sources import io
    root, calls = str(tmp_path / "cache"), []

    def build(n, meanwhile=None):
        def run():
            calls.append(n)
            if meanwhile:
                meanwhile()
            return spark.range(n)
        return run

    def dies():
        raise RuntimeError("builder lost")

    for _ in range(2):                                  # a builder that dies leaves nothing to read
        try:
            io.cached_table(spark, "t", 0.5, dies, root)
            raise AssertionError("no error")
        except RuntimeError:
            pass
    # Another builder commits while this one builds: both read the winner's copy.
    other = lambda: io.cached_table(spark, "t", 0.5, build(7), root)
    assert io.cached_table(spark, "t", 0.5, build(3, other), root).count() == 7
    assert io.cached_table(spark, "t", 0.5, build(9), root).count() == 7 and calls == [3, 7]
    assert io.cached_table(spark, "t", 0.4, build(2), root).count() == 2
