"""Typed sources, table validation and the JSON/Parquet sinks.

Output folders live under the cluster's shared ``spark.checkpoint.dir`` unless a
path is given — never a machine-local folder.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedsight.functions.constants import NA_TOKENS
from fedsight.operators import clean
from fedsight.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, *parts: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "fedsight-out", *parts)


def fresh_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# A1 -------------------------------------------------------------------------------
def read_csv_typed(spark: SparkSession, path: str, columns: dict[str, str],
                   na_tokens: Sequence[str] = NA_TOKENS, timestamp_cols: Sequence[str] = ()) -> DataFrame:
    """CSV with header, read as text (no inference), pruned to ``columns``,
    NA spellings -> null, then ``try_cast`` to the given types; timestamps that
    do not parse become null."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cols = list(columns)
    df = clean.normalise_na(raw.select(*cols), cols, na_tokens)
    df = clean.parse_timestamps(df, [c for c in cols if c in timestamp_cols])
    return clean.typed(df, {c: t for c, t in columns.items() if c not in timestamp_cols})


# A4 -------------------------------------------------------------------------------
def validate_table(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: present?, row count, null count — all
    counts in a single aggregate."""
    present = [c for c in required if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(c).isNull()).alias(f"_null_{i}")
                                                 for i, c in enumerate(present)]
    wide = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(c in present).alias("present"), F.col("_rows").alias("n_rows"),
                      (F.col(f"_null_{present.index(c)}") if c in present else F.lit(None).cast("long")).alias("n_null")) for c in required]
    return wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def _check_columns(df: DataFrame, features: Sequence[str], label: str | None, width: int | None = None) -> None:
    """The part of the contract that the schema shows (no job)."""
    twice = sorted({c for c in features if list(features).count(c) > 1})
    if twice:
        raise ValueError(f"features named twice: {twice}")
    if label in features:
        raise ValueError(f"the label {label} is among the features")
    missing = [c for c in [*features, *([label] if label else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"table: missing required columns {missing}")
    types = {f.name: f.dataType for f in df.schema.fields}
    other = [c for c in features if not isinstance(types[c], T.NumericType)]
    if other:
        raise ValueError(f"features that are not numbers: {other}")
    if width is not None and len(features) != width:
        raise ValueError(f"the model takes {width} features, the table has {len(features)}")


def check_features(df: DataFrame, features: Sequence[str], label: str, width: int | None = None) -> None:
    """The contract of a training table: feature names are unique and present,
    the label is none of them, every feature is numeric, there are as many as a
    model of ``width`` inputs takes, and the label is never null and 0 or 1 (one
    aggregate)."""
    _check_columns(df, features, label, width)
    require(df, [*features, label])
    n, good = df.agg(F.count(F.lit(1)), F.count_if(F.col(label).isin(0, 1))).first()
    if n != good:
        raise ValueError(f"{n - good} of {n} rows have a label other than 0 and 1")


def write_counted(df: DataFrame, path: str, cols: Sequence[str], label: str | None = None) -> dict[str, int]:
    """Write ``df`` as Parquet to the new folder ``path`` and return what the
    written table holds: n_rows, for the i-th of ``cols`` null_i, nan_i and
    inf_i, and bad_label (labels other than 0 and 1; nulls are bad). ``df`` is
    computed once; one aggregate then reads these columns of the written files.
    Metrics of the write itself (``DataFrame.observe``) would save that pass, but
    in Spark 4.1 a session that has used them can no longer send a fitted
    binary classifier to its tasks: the model's training summary holds the
    session, and its observation manager is not serializable."""
    df.write.parquet(path)
    metrics = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        metrics += [F.count_if(x.isNull()).alias(f"null_{i}"), F.count_if(F.isnan(x)).alias(f"nan_{i}"),
                    F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"inf_{i}")]
    if label:
        metrics.append(F.count_if(~F.coalesce(F.col(f"`{label}`").isin(0, 1), F.lit(False))).alias("bad_label"))
    return df.sparkSession.read.schema(df.schema).parquet(path).agg(*metrics).first().asDict()


def write_training_table(df: DataFrame, path: str, features: Sequence[str], label: str | None = None,
                         width: int | None = None) -> DataFrame:
    """Write a training table that keeps its contract, else raise and commit
    nothing: names, types and ``width`` (a model's number of inputs) are checked
    before any job; rows, nulls, NaN, infinities and labels on the files written
    (``df`` is computed once). They lie in a folder of their own below ``path``,
    which becomes the table once the check has passed and COMMITTED names it (see
    :func:`read_committed`); a second writer of the same path is an error."""
    _check_columns(df, features, label, width)
    spark, name = df.sparkSession, f"build-{uuid.uuid4().hex}"
    n = write_counted(df, f"{path}/{name}", features, label)
    bad = [f"{c}: {n[f'null_{i}']} null, {n[f'nan_{i}']} NaN, {n[f'inf_{i}']} infinite" for i, c in enumerate(features)
           if n[f"null_{i}"] or n[f"nan_{i}"] or n[f"inf_{i}"]]
    if n.get("bad_label"):
        bad.append(f"{n['bad_label']} of {n['n_rows']} rows have a label other than 0 and 1")
    if not n["n_rows"]:
        bad.append("no rows")
    if bad:
        raise ValueError(f"the table breaks its contract: {'; '.join(bad)}")
    if not commit(spark, path, name):
        raise ValueError(f"{path} holds another table")
    return read_committed(spark, path)


def require(df: DataFrame, required: Sequence[str], name: str = "table") -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing required columns {missing}")
    if df.limit(1).count() == 0:
        raise ValueError(f"{name}: empty")


# A5 -------------------------------------------------------------------------------
SUMMARY_SCHEMA = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("round", T.IntegerType()),
    T.StructField("summary", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
])


def nest_summaries(importance: DataFrame) -> DataFrame:
    """Long (client_id, round, method, feature, value) -> one record per
    (client, round) with summary{method -> {feature -> value}}."""
    per_method = importance.groupBy("client_id", "round", "method").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    return per_method.groupBy("client_id", "round").agg(
        F.map_from_entries(F.collect_list(F.struct("method", "m"))).alias("summary"))


def unnest_summaries(nested: DataFrame) -> DataFrame:
    m = nested.select("client_id", "round", F.explode("summary").alias("method", "features"))
    return m.select("client_id", "round", "method", F.explode("features").alias("feature", "value"))


def write_summaries_json(nested: DataFrame, path: str) -> None:
    """One folder per (round, client) — the reference writes one file per pair."""
    nested.repartition("round", "client_id").write.mode("overwrite").partitionBy("round", "client_id").json(path)


def read_summaries_json(spark: SparkSession, path: str) -> DataFrame:
    body = T.StructType([f for f in SUMMARY_SCHEMA.fields if f.name not in ("round", "client_id")])
    df = spark.read.schema(body.add("round", T.IntegerType()).add("client_id", T.StringType())).json(path)
    return df.select("client_id", F.col("round").cast("int").alias("round"), "summary")


# A6 / A7 ---------------------------------------------------------------------------
def write_history_json(global_importance: DataFrame, path: str, run_id: str) -> None:
    """Round history keyed by round (text key, as a JSON object would have)."""
    h = global_importance.groupBy("round", "method").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("features"))
    h = h.select(F.col("round").cast("string").alias("round_key"), "method", "features",
                 F.lit(run_id).alias("run_id"))
    h.write.mode("append").partitionBy("run_id").json(path)


def read_history_json(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Reload a history; round keys text -> int; default: the latest run
    (largest run_id, run ids sort by time)."""
    schema = T.StructType([
        T.StructField("round_key", T.StringType()), T.StructField("method", T.StringType()),
        T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("run_id", T.StringType())])
    df = spark.read.schema(schema).json(path)
    if run_id is None:
        latest = df.agg(F.max("run_id").alias("r")).scalar()
        df = df.where(F.col("run_id") == latest)
    else:
        df = df.where(F.col("run_id") == run_id)
    return df.select(F.col("round_key").cast("int").alias("round"), "method",
                     F.explode("features").alias("feature", "value"))


# A8 -------------------------------------------------------------------------------
def save_results(results: DataFrame, path: str) -> None:
    results.repartition("experiment").write.mode("overwrite").partitionBy("experiment").parquet(path)


# A9 -------------------------------------------------------------------------------
def cache_key(task: str, fraction: float) -> str:
    return hashlib.md5(f"{task}_{fraction}".encode()).hexdigest()


def input_state(df: DataFrame) -> str:
    """Fingerprint of a file scan's inputs: paths, sizes and modification times
    (only file metadata is read)."""
    m = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    h = F.xxhash64("file_path", "file_size", "file_modification_time")
    return str(tuple(m.agg(F.count(F.lit(1)), F.bit_xor(h)).first()))


def cached_table(spark: SparkSession, task: str, fraction: float, build, root: str | None = None) -> DataFrame:
    """Read-through materialisation of a prepared table keyed by
    md5("{task}_{fraction}"): build and write it when absent, then read it. The
    caller's ``root`` names whatever else the table depends on (see
    :func:`input_state`).

    A builder writes to a folder of its own and commits by creating one small
    file that names it. The file is created once and never replaced, so of two
    builders the first wins and the other reads the winner's copy; a builder
    that dies leaves a folder that nobody reads."""
    root = root or shared_path(spark, "feature-cache")
    entry = os.path.join(root, cache_key(task, fraction))
    mark, fs = _mark(spark, entry)
    if not fs.exists(mark):
        name = f"build-{uuid.uuid4().hex}"
        build().write.parquet(f"{entry}/{name}")
        commit(spark, entry, name)
    return read_committed(spark, entry)


def _mark(spark: SparkSession, entry: str):
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{entry}/COMMITTED")
    return mark, mark.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(spark: SparkSession, entry: str, name: str) -> bool:
    """Make the folder ``name`` below ``entry`` its table by creating the file
    that names it; false if another one was committed before."""
    mark, fs = _mark(spark, entry)
    try:
        out = fs.create(mark, False)
    except Exception:
        if not fs.exists(mark):
            raise
        return False
    out.write(bytearray(name.encode()))
    out.close()
    return True


def read_committed(spark: SparkSession, entry: str) -> DataFrame:
    mark, _ = _mark(spark, entry)
    return spark.read.parquet(f"{entry}/{spark.read.text(str(mark), wholetext=True).first()[0]}")
