"""Deterministic pseudo-random draws keyed by row content.

A draw is ``u = (first 32 bits of md5(k1|k2|...|seed) + 0.5) / 2**32``: uniform on
(0, 1), never exactly 0 or 1, identical on every executor, after every retry
and in any SQL engine that has ``md5`` — which makes samples, splits, noise and
perturbations reproducible and checkable against a SQL oracle. Production
privacy noise should use :func:`fresh_uniform` instead (unpredictable).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def hash_hex(*keys, seed: int | str = 42) -> Column:
    return F.md5(F.concat_ws("|", *[_key(k) for k in keys], F.lit(str(seed))))


def uniform(*keys, seed: int | str = 42) -> Column:
    """Uniform(0,1) draw keyed by ``keys`` (column names or Columns) and ``seed``."""
    h = F.substring(hash_hex(*keys, seed=seed), 1, 8)
    return (F.conv(h, 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_32)


def fresh_uniform(seed: int | None = None) -> Column:
    """Non-reproducible uniform(0,1) (``rand``) for real privacy releases."""
    r = F.rand(seed) if seed is not None else F.rand()
    return F.least(F.greatest(r, F.lit(1e-12)), F.lit(1 - 1e-12))


def laplace(u: Column, scale) -> Column:
    """Inverse-CDF Laplace(0, scale) from a uniform draw ``u`` in (0, 1)."""
    d = u - F.lit(0.5)
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -b * F.signum(d) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(d))


def exponential(u: Column) -> Column:
    """Exp(1) draw from a uniform; normalised exponentials are Dirichlet(1,...,1)."""
    return -F.log(u)


# --- SQL text of the same draws, for the DuckDB oracles -----------------------

def sql_uniform(keys: list[str], seed: int | str = 42) -> str:
    k = ", ".join(f"CAST({x} AS VARCHAR)" for x in keys)
    return (f"((CAST(('0x' || substr(md5(concat_ws('|', {k}, '{seed}')), 1, 8)) AS BIGINT)"
            f" + 0.5) / 4294967296.0)")


def sql_laplace(u: str, scale: str) -> str:
    return f"(-({scale}) * sign(({u}) - 0.5) * ln(1.0 - 2.0 * abs(({u}) - 0.5)))"


def py_uniform(keys: list, seed: int | str = 42) -> float:
    """The same draw computed in Python (for parameters such as client shares)."""
    import hashlib
    text = "|".join([str(k) for k in keys] + [str(seed)])
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / TWO_32
