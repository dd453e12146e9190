"""Tree sums of packed vectors."""

import numpy as np
import pytest

from fedsight.functions.tensors import packed, tree_sum, unpacked


@pytest.mark.parametrize("n_parts", [1, 3, 16, 17, 70])
def test_tree_sum_equals_plain_sum(spark, n_parts):
    rng = np.random.default_rng(n_parts)
    rows, want = [], {}
    for p in range(n_parts):
        for k in ("a", None, "b"):
            if rng.random() < .8 or p == 0:
                v = rng.integers(-9, 9, 5 if k == "b" else 3).astype(float)
                rows.append((k, p, packed(v)))
                want[k] = want.get(k, 0) + v
    rows.append(("a", 0, None))
    df = spark.createDataFrame(rows, "key string, part long, value binary").repartition(4)
    got = {r.key: unpacked(r.value).tolist() for r in tree_sum(df, ["key"], n_parts, fan_in=4).collect()}
    assert got == {k: v.tolist() for k, v in want.items()}


def test_no_parts(spark):
    df = spark.createDataFrame([], "key string, part long, value binary")
    assert tree_sum(df, ["key"], 0).count() == 0
