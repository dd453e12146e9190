"""Joins and per-entity aggregates (C1-C7, D1-D13) and the feature table.

Design rule: one conditional aggregate per source table. Every per-item /
per-category / per-condition column of a source is one aggregate expression in
a single ``groupBy(key).agg(...)`` (one shuffle of partial aggregates), then one
left join per source — instead of one filter + group + join per item.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.operators import clean
from fedsight.session import cut_lineage

# C1 / C2 / C3 / C6 ---------------------------------------------------------------

def left_join(fact: DataFrame, dim: DataFrame, keys) -> DataFrame:
    """Left equi-join on one or more keys; the planner (adaptive execution, from
    the sizes it measures) broadcasts the dimension or shuffles both sides. With a non-unique dimension key the fact row fans out (one row per match)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return fact.join(dim, keys, "left")


def restrict_to_keys(big: DataFrame, keys: DataFrame, on, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan of ``big`` restricted to a key set (left semi join) with column
    pruning; Spark turns this into a broadcast/shuffle semi join and may add a
    runtime bloom filter on the scan."""
    on = [on] if isinstance(on, str) else list(on)
    b = big.select(*sorted(set(columns) | set(on))) if columns else big
    return b.join(keys.select(*on).distinct(), on, "left_semi")


def split_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys present in both parts (must be empty for a clean split)."""
    return train.select(key).distinct().join(test.select(key), key, "left_semi")


# D1 ----------------------------------------------------------------------------

def first_value_exprs(item_col: str, value_col: str, items: Mapping[str, str],
                      order_cols: Sequence[str]) -> list[Column]:
    """One ``min_by`` per item: the value of the earliest (by ``order_cols``)
    non-null measurement of that item. Rows of other items get a null ordering
    and are ignored by ``min_by``."""
    order = F.struct(*[F.col(c) for c in order_cols])
    out = []
    for item, name in items.items():
        hit = (F.col(item_col) == F.lit(item)) & F.col(value_col).isNotNull()
        out.append(F.min_by(F.col(value_col), F.when(hit, order)).cast("double").alias(name))
    return out


def first_value_pivot(df: DataFrame, key: str, item_col: str, value_col: str,
                      items: Mapping[str, str], order_cols: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*first_value_exprs(item_col, value_col, items, order_cols))


# D2 / D4 / D5 / D6 / D7 -----------------------------------------------------------

def count_expr(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def category_count_exprs(cat: Column, values: Sequence[str], prefix: str) -> list[Column]:
    return [F.count_if(cat == F.lit(v)).alias(f"{prefix}{v}") for v in values]


def ranked_category_exprs(cat: Column, values: Sequence[str], n: int, prefix: str) -> list[Column]:
    """Counts of the most frequent categories under names that do not depend on
    the data: ``<prefix>1`` .. ``<prefix>n`` by rank, and each one's category in
    ``<prefix>i_category`` (fewer than n categories: 0 and null)."""
    padded = [*values, *[None] * n][:n]
    return ([(F.count_if(cat == F.lit(v)) if v is not None else F.lit(0).cast("long")).alias(f"{prefix}{i}") for i, v in enumerate(padded, 1)]
            + [F.lit(v).cast("string").alias(f"{prefix}{i}_category") for i, v in enumerate(padded, 1)])


def prefix_count_exprs(code_col: str, prefixes: Mapping[str, Sequence[str]], prefix: str = "HAS_") -> list[Column]:
    out = []
    for name, ps in prefixes.items():
        cond = None
        for p in ps:
            c = F.col(code_col).startswith(F.lit(p))
            cond = c if cond is None else (cond | c)
        out.append(F.count_if(F.coalesce(cond, F.lit(False))).alias(f"{prefix}{name}"))
    return out


def anchored_pattern(codes: Sequence[str], literal: bool = True) -> str:
    alts = [re.escape(c) if literal else c for c in codes]
    return "^(" + "|".join(alts) + ")"


def regex_flag_exprs(code_col: str, codes: Mapping[str, Sequence[str]], prefix: str = "HAS_",
                     literal: bool = True) -> list[Column]:
    """1 when any code of the group matches one anchored alternative."""
    return [F.max(F.coalesce(F.col(code_col).rlike(anchored_pattern(cs, literal)), F.lit(False)).cast("int"))
            .alias(f"{prefix}{name}") for name, cs in codes.items()]


def keyword_flag_exprs(text_col: str, classes: Mapping[str, Sequence[str]]) -> list[Column]:
    """1 when the text contains any keyword of the class, case-insensitively."""
    out = []
    for name, words in classes.items():
        pat = "(?i)(" + "|".join(re.escape(w) for w in words) + ")"
        out.append(F.max(F.coalesce(F.col(text_col).rlike(pat), F.lit(False)).cast("int")).alias(name))
    return out


def entity_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(count_expr(name))


def top_categories(df: DataFrame, cat: Column | str, n: int) -> DataFrame:
    """The n most frequent categories, ties broken by category ascending."""
    c = F.col(cat) if isinstance(cat, str) else cat
    return (df.select(c.alias("category")).where(F.col("category").isNotNull())
            .groupBy("category").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("category")).limit(n))


def top_category_values(df: DataFrame, cat: Column | str, n: int) -> list[str]:
    """Collect the (bounded: ``n``) top category names — pivot columns must be
    known when the plan is built."""
    return [r["category"] for r in top_categories(df, cat, n).collect()]


def category_crosstab(df: DataFrame, key: str, cat: Column | str, values: Sequence[str], prefix: str, ranks: int | None = None) -> DataFrame:
    """Counts of the given categories per key, in columns named by category, or
    with ``ranks`` by rank (a schema that does not depend on the data)."""
    c = F.col(cat) if isinstance(cat, str) else cat
    if ranks is not None:
        return df.groupBy(key).agg(*ranked_category_exprs(c, values, ranks, prefix))
    return df.groupBy(key).agg(*category_count_exprs(c, values, prefix))


# D8 / D9 / D10 / D11 / D12 / D13 ---------------------------------------------------

def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.col(label).cast("long")).alias("n_positive"),
                 F.avg(F.col(label).cast("double")).alias("positive_rate"))


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, n_missing)")
            .where("n_missing > 0"))


def describe_columns(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """count, mean, sample std, min, quartiles, max of each column (long form)."""
    from fedsight.functions.quantiles import quantile_values
    qv = quantile_values(df, list(cols), [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"),
                 F.array(*[F.lit(qv[(c, p)]).cast("double") for p in (0.25, 0.5, 0.75)]).alias(f"q{i}"),
                 F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    r = lambda e: F.round(e, digits)
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"), r(F.col(f"m{i}")).alias("mean"),
                      r(F.col(f"s{i}")).alias("std"), r(F.col(f"lo{i}")).alias("min"), r(F.col(f"q{i}")[0]).alias("q25"),
                      r(F.col(f"q{i}")[1]).alias("q50"), r(F.col(f"q{i}")[2]).alias("q75"), r(F.col(f"hi{i}")).alias("max"))
             for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max]; the max lands in the last bin."""
    st = clean.scalars(df, [F.min(F.col(col).cast("double")).alias("lo"),
                            F.max(F.col(col).cast("double")).alias("hi")])
    lo, hi = st["lo"], st["hi"]
    width = F.when(hi > lo, (hi - lo) / F.lit(bins)).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col(col) - lo) / width).cast("int"), F.lit(bins - 1))
    return (df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", F.round(lo + F.col("bin") * width, 6).alias("bin_lo"),
                    F.round(lo + (F.col("bin") + 1) * width, 6).alias("bin_hi"), "n"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of every ordered pair, all computed in one aggregate."""
    pairs = [(a, b) for a in cols for b in cols]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
            for i, (a, b) in enumerate(pairs)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{a}', '{b}', round(`c{i}`, {digits})" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, corr)")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# The feature table (C4 + D1/D2/D4/D5 + B2-B6) -------------------------------------

def feature_table(admissions: DataFrame, patients: DataFrame, measurements: DataFrame,
                  diagnoses: DataFrame, *, lab_items: Mapping[str, str],
                  vital_items: Mapping[str, str], code_prefixes: Mapping[str, Sequence[str]],
                  top_n: int = 10, measurement_order: Sequence[str] = ("charttime", "tie1", "tie2"),
                  discharge_from_measurements: bool = True,
                  prescriptions: DataFrame | None = None,
                  drug_classes: Mapping[str, Sequence[str]] | None = None,
                  materialize: bool = True, rank_names: bool = False, procedures: DataFrame | None = None) -> DataFrame:
    """One row per admission: age, length of stay, first lab/vital values,
    diagnosis count, top-``top_n`` code-category counts, comorbidity counts,
    optional drug-class flags, label ``mortality``. Categories are those of
    ``procedures`` (with their ``procedure_count``), or of the diagnoses if there
    is no such table; comorbidities always come from the diagnoses. Category counts are named
    ``proc_<category>``, or with ``rank_names`` ``proc_top<rank>`` beside the
    category itself, so that the schema does not depend on the data.

    Sources: admissions(hadm_id, subject_id, admittime, expire_flag[, dischtime]),
    patients(subject_id, dob), measurements(hadm_id, lab_item, lab_value,
    vital_item, vital_value, charttime, ...), diagnoses(hadm_id, icd9_code),
    prescriptions(hadm_id, drug), procedures(hadm_id, icd9_code).
    """
    base = left_join(admissions, patients, "subject_id")
    base = base.withColumn("age", clean.in_range_or_null(clean.age_years("dob", "admittime")))

    # measurements: one aggregate for labs, vitals (and discharge time)
    m_aggs = (first_value_exprs("lab_item", "lab_value", lab_items, measurement_order)
              + first_value_exprs("vital_item", "vital_value", vital_items, measurement_order))
    if discharge_from_measurements:
        m_aggs.append(F.max("charttime").alias("dischtime"))
    m = measurements.groupBy("hadm_id").agg(*m_aggs)

    # diagnoses: count, comorbidity counts and, without procedures, the top categories crosstab in one aggregate
    cat = clean.code_prefix("icd9_code", 2)
    coded = diagnoses if procedures is None else procedures
    top = top_category_values(coded, cat, top_n)
    procs = [f"proc_top{i}" for i in range(1, top_n + 1)] if rank_names else [f"proc_{v}" for v in top]
    names = ranked_category_exprs(cat, top, top_n, "proc_top")[top_n:] if rank_names else []
    crosstab = ranked_category_exprs(cat, top, top_n, "proc_top")[:top_n] if rank_names else category_count_exprs(cat, top, "proc_")
    d = diagnoses.groupBy("hadm_id").agg(
        count_expr("diagnosis_count"), *(crosstab if procedures is None else []), *prefix_count_exprs("icd9_code", code_prefixes, "has_"))

    out = base.join(m, "hadm_id", "left").join(d, "hadm_id", "left")
    if procedures is not None:
        procs = ["procedure_count", *procs]
        out = out.join(procedures.groupBy("hadm_id").agg(count_expr("procedure_count"), *crosstab), "hadm_id", "left")
    flag_cols: list[str] = []
    if prescriptions is not None and drug_classes:
        p = prescriptions.groupBy("hadm_id").agg(count_expr("medication_count"),
                                                 *keyword_flag_exprs("drug", drug_classes))
        out = out.join(p, "hadm_id", "left")
        flag_cols = ["medication_count", *drug_classes.keys()]

    out = out.withColumn("los", clean.duration_days("admittime", "dischtime"))
    if materialize:
        # The medians below need a pass over the joined table; cut it to the shared
        # checkpoint folder so the source aggregates run once (and survive executor loss).
        out = cut_lineage(out.select("hadm_id", "expire_flag", "age", "los",
                                     *lab_items.values(), *vital_items.values(),
                                     "diagnosis_count", *procs,
                                     *[f"has_{k}" for k in code_prefixes], *flag_cols))
    numeric = ["age", "los", *lab_items.values(), *vital_items.values()]
    counts = ["diagnosis_count", *procs, *[f"has_{k}" for k in code_prefixes], *flag_cols]
    out = clean.median_impute(out, numeric)
    out = out.fillna(0, subset=counts)
    return out.select("hadm_id", *numeric, *counts, *names,
                      F.coalesce(F.col("expire_flag").cast("int"), F.lit(0)).alias("mortality"))
