"""Small column-expression builders shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def dot_array(arr: Column, weights: Sequence[float]) -> Column:
    """Σ arr[i]·w[i] with ``weights`` inlined as a literal array (a broadcast
    parameter of bounded size, evaluated JVM-side)."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    prods = F.zip_with(arr, w, lambda a, b: a.cast("double") * b)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def dot_columns(cols: Sequence[str], weights: Sequence[float]) -> Column:
    terms = [F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(cols, weights)]
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def rnd(c, digits: int = 6) -> Column:
    return F.round(col(c), digits)
