"""Scalar cleaning and encoding.

All work is column expressions (whole-stage codegen). Statistics that a rule
needs (medians, quartiles, category lists) are computed in ONE aggregate for
all columns and applied through a one-row broadcast join, so the data is read
once for the statistics and once for the rewrite — never once per column.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedsight.functions.constants import AGE_RANGE, IQR_FACTOR, NA_TOKENS
from fedsight.functions.quantiles import quantile_values

_DOUBLE = "double"


def scalars(df: DataFrame, exprs: list[Column]) -> dict[str, Column]:
    """Global statistics as scalar-subquery Columns keyed by alias.

    Catalyst merges scalar subqueries over the same plan into ONE aggregate
    (MergeScalarSubqueries), so k statistics cost one pass, and the values are
    inlined into the consuming projection without a join.
    """
    stats = df.agg(*exprs)
    return {name: stats.select(name).scalar() for name in stats.columns}


# B1 -------------------------------------------------------------------------
def parse_timestamps(df: DataFrame, cols: Iterable[str], fmt: str | None = None) -> DataFrame:
    """Parse text to timestamp; unparseable -> null; timestamp columns pass."""
    out = df
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            continue
        if isinstance(dt, T.DateType):
            out = out.withColumn(c, F.col(c).cast("timestamp"))
            continue
        s = F.trim(F.col(c).cast("string"))
        parsed = F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)
        out = out.withColumn(c, parsed)
    return out


# A1 -------------------------------------------------------------------------
def normalise_na(df: DataFrame, cols: Iterable[str], tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text NA spellings (after trimming) become null."""
    out = df
    for c in cols:
        s = F.col(c)
        out = out.withColumn(c, F.when(F.trim(s).isin(list(tokens)), F.lit(None)).otherwise(s))
    return out


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to the given types; bad values -> null (``try_cast``)."""
    out = df
    for c, t in types.items():
        out = out.withColumn(c, F.trim(F.col(c).cast("string")).try_cast(t) if t != "string" else F.col(c))
    return out


# A3 -------------------------------------------------------------------------
def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


# B2 / B3 / B4 ----------------------------------------------------------------
def age_years(birth: str, ref: str) -> Column:
    """Completed years between ``birth`` and ``ref`` (calendar rule, not months/12)."""
    b, r = F.col(birth), F.col(ref)
    not_yet = (F.month(r) < F.month(b)) | ((F.month(r) == F.month(b)) & (F.dayofmonth(r) < F.dayofmonth(b)))
    return (F.year(r) - F.year(b) - not_yet.cast("int")).cast(_DOUBLE)


def duration_days(start: str, end: str) -> Column:
    """(end - start) in fractional days."""
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)).cast(_DOUBLE) / F.lit(86400e6)


def in_range_or_null(c, lo=AGE_RANGE[0], hi=AGE_RANGE[1]) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.between(lo, hi), x)


# B8 -------------------------------------------------------------------------
def finite_or_null(c) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast(_DOUBLE)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


# B5 / B8 ---------------------------------------------------------------------
def median_impute(df: DataFrame, cols: Sequence[str], zero_if_undefined: bool = False,
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Fill nulls (and NaN/±inf) of ``cols`` with the column's exact median over
    ``fit_on`` (default: ``df`` itself); all medians come from the same passes
    (functions/quantiles.py) and enter the rewrite as literals."""
    if not cols:
        return df
    src = fit_on if fit_on is not None else df
    qv = quantile_values(src, list(cols), [0.5])
    fills = {}
    for i, c in enumerate(cols):
        m = qv[(c, 0.5)]
        fill = F.lit(m).cast("double") if m is not None else F.lit(None).cast("double")
        if zero_if_undefined:
            fill = F.coalesce(fill, F.lit(0.0))
        fills[c] = F.coalesce(finite_or_null(c), fill)
    return df.withColumns(fills)


# B6 -------------------------------------------------------------------------
def zero_fill(df: DataFrame, prefixes: Sequence[str] = ("PROC_", "HAS_", "DIAGNOSIS_", "PROCEDURE_"),
              cols: Sequence[str] | None = None) -> DataFrame:
    targets = list(cols) if cols is not None else [
        c for c in df.columns if c.upper().startswith(tuple(p.upper() for p in prefixes))]
    return df.fillna(0, subset=targets) if targets else df


# B7 -------------------------------------------------------------------------
def drop_null_keys(df: DataFrame, keys: Sequence[str], label: str | None = None) -> DataFrame:
    out = df.dropna(subset=list(keys))
    if label:
        out = out.withColumn(label, F.coalesce(F.col(label).cast("int"), F.lit(0)))
    return out


# B9 -------------------------------------------------------------------------
def clip_binary(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.least(F.greatest(F.coalesce(x.cast(_DOUBLE), F.lit(0.0)).cast("int"), F.lit(0)), F.lit(1))


# B10 ------------------------------------------------------------------------
def iqr_clip(df: DataFrame, cols: Sequence[str], factor: float = IQR_FACTOR,
             fit_on: DataFrame | None = None) -> DataFrame:
    """Outlier clip at [q1 - f*IQR, q3 + f*IQR] of the finite values; IQR 0 or
    undefined -> [min, max]; still undefined -> [0, 1]. NaN/±inf are first
    replaced by the median (0 when undefined), then the clip applies."""
    if not cols:
        return df
    src = fit_on if fit_on is not None else df
    qv = quantile_values(src, list(cols), [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = finite_or_null(c)
        aggs += [F.min(x).alias(f"_mn_{i}"), F.max(x).alias(f"_mx_{i}")]
    st = scalars(src, aggs)
    lit = lambda v: F.lit(v).cast("double")
    new = {}
    for i, c in enumerate(cols):
        q1, med, q3 = lit(qv[(c, 0.25)]), lit(qv[(c, 0.5)]), lit(qv[(c, 0.75)])
        iqr = q3 - q1
        bad = iqr.isNull() | (iqr == 0)
        lo = F.when(bad, st[f"_mn_{i}"]).otherwise(q1 - F.lit(factor) * iqr)
        hi = F.when(bad, st[f"_mx_{i}"]).otherwise(q3 + F.lit(factor) * iqr)
        undefined = lo.isNull() | hi.isNull()
        lo = F.when(undefined, F.lit(0.0)).otherwise(lo)
        hi = F.when(undefined, F.lit(1.0)).otherwise(hi)
        filled = F.coalesce(finite_or_null(c), med, F.lit(0.0))
        new[c] = F.least(F.greatest(filled, lo), hi)
    return df.withColumns(new)


# B11 ------------------------------------------------------------------------
def remaining_invalid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (column, n_null, n_inf) of problems left after cleaning."""
    aggs = []
    for c in cols:
        x = F.col(c).cast(_DOUBLE)
        aggs += [F.count_if(x.isNull() | F.isnan(x)).alias(f"{c}__null"),
                 F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"{c}__inf")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__null`, `{c}__inf`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, n_null, n_inf)")


def verify_clean(df: DataFrame, cols: Sequence[str]) -> None:
    bad = remaining_invalid(df, cols).where("n_null > 0 OR n_inf > 0").collect()   # a row a column at most
    if bad:
        raise ValueError(f"unclean feature columns: {[(r[0], r[1], r[2]) for r in bad]}")


# B12 ------------------------------------------------------------------------
def select_features(df: DataFrame, exclude: Sequence[str] = (), drop_prefixes: Sequence[str] = ("row", "index")) -> list[str]:
    ex = {e.upper() for e in exclude}
    return [c for c in df.columns if c.upper() not in ex and not c.lower().startswith(tuple(drop_prefixes))]


# B13 ------------------------------------------------------------------------
def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each string column by the 0-based position of its value among the
    column's sorted distinct values; null is the category 'nan'. The code table
    has one row per distinct value and is numbered by a range-partitioned global
    index; the planner picks its join from the table's real size."""
    from fedsight.functions.rank import ordered_index
    out = df
    for c in cols:
        v = F.coalesce(F.col(c), F.lit("nan"))
        codes = ordered_index(df.select(v.alias("_v")).distinct(), ["_v"], "_code")
        codes = codes.withColumn("_code", F.col("_code").cast("int"))
        out = out.withColumn("_v", v).join(codes, "_v", "left").drop("_v", c).withColumnRenamed("_code", c)
    return out


# B14 / B16 ---------------------------------------------------------------------
def code_prefix(c, n: int = 2) -> Column:
    return F.substring((F.col(c) if isinstance(c, str) else c).cast("string"), 1, n)


def base_feature_name(c) -> Column:
    """Identifier inside a bin condition: 'x > 1' -> x, '0.5 < x <= 1' -> x."""
    x = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(x, r"([A-Za-z_][A-Za-z0-9_.#]*)", 1)


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """z-score with mean / population std of ``fit_on`` (one aggregate; constant
    columns are only centred)."""
    src = fit_on if fit_on is not None else df
    st = src.agg(*[F.avg(F.col(c).cast(_DOUBLE)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c).cast(_DOUBLE)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    new = {}
    for i, c in enumerate(cols):
        m, s = st[f"m{i}"] or 0.0, st[f"s{i}"] or 0.0
        new[c] = (F.col(c).cast(_DOUBLE) - F.lit(m)) / F.lit(s if s > 0 else 1.0)
    return df.withColumns(new)
