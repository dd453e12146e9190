"""Every registered query builds and runs on the smallest tables; the flagship
has a stable schema."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "hadm_id" and "mortality" in df.columns


def test_every_query_has_sql_or_is_declared_rows_only(spark):
    qs, ors = E.queries(), E.oracle_sql()
    rows_only = set(qs) - set(ors) - set(E.EXTRA_QUERIES)
    assert rows_only == {"fit_classifier", "param_search", "perceptron_fit", "federated_explained", "lime_batch", "kernel_shap_batch",
                         "central_run", "federated_run"}


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.EXTRA_QUERIES)))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()


def test_comparison_of_all_clients(spark):
    """Every client of a round and method is compared."""
    from fedsight.sources import testbed as tb
    every = {tuple(r) for r in tb.importance(spark, SF).select("round", "method", "client_id").distinct().collect()}
    got = E.queries()["client_comparison_all"](spark, SF)
    assert {tuple(r) for r in got.select("round", "method", "client_id").distinct().collect()} == every
