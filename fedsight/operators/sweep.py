"""Experiment configurations and sweeps (L1, L2)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsight.functions.parallel import run_settings


def experiment_rows(spark: SparkSession, path: str, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Flatten a grouped config file {experiment_groups: [{group_name,
    experiments: [...]}]} into one numbered row per experiment (1-based, in file
    order); missing top-level keys are filled from ``defaults``."""
    raw = spark.read.option("multiLine", True).json(path)
    g = raw.select(F.posexplode("experiment_groups").alias("_gi", "_g"))
    sizes = raw.select(F.transform("experiment_groups", lambda x: F.size(x["experiments"])).alias("_sizes"))
    g = g.join(sizes, how="inner")  # the config file is one row: its group sizes
    e = g.select("_gi", "_sizes", F.col("_g.group_name").alias("group"),
                 F.posexplode("_g.experiments").alias("_ei", "_e"))
    offset = F.aggregate(F.slice("_sizes", 1, F.col("_gi")), F.lit(0), lambda acc, v: acc + v)
    e = e.select((offset + F.col("_ei") + 1).alias("experiment_id"), "group", "_e.*")
    for k, v in (defaults or {}).items():
        if k in e.columns:
            e = e.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
        else:
            e = e.withColumn(k, F.lit(v))
    return e


def experiment_sets(spark: SparkSession, path: str) -> DataFrame:
    """Flatten {set_name: {exp_name: {params}}} into numbered rows (1-based,
    sets then experiments in file order); params stay a map of JSON text."""
    raw = spark.read.option("multiLine", True).text(path, wholetext=True)
    m = raw.select(F.from_json("value", "map<string, map<string, string>>").alias("_m"))
    s = m.select(F.posexplode(F.map_entries("_m")).alias("_si", "_s"))
    sizes = m.select(F.transform(F.map_values("_m"), lambda x: F.size(x)).alias("_sizes"))
    s = s.join(sizes, how="inner")
    e = s.select("_si", "_sizes", F.col("_s.key").alias("set_name"),
                 F.posexplode(F.map_entries("_s.value")).alias("_ei", "_e"))
    offset = F.aggregate(F.slice("_sizes", 1, F.col("_si")), F.lit(0), lambda acc, v: acc + v)
    return e.select((offset + F.col("_ei") + 1).alias("experiment_id"), "set_name",
                    F.col("_e.key").alias("experiment"), F.from_json(F.col("_e.value"), "map<string,string>").alias("params"))


def run_sweep(configs: Sequence[Mapping[str, object]], run: Callable[[Mapping[str, object]], DataFrame],
              name_key: str = "name", parallel: int = 1) -> DataFrame:
    """Run the configurations, ``parallel`` at the same time over the same
    prepared inputs, and stack the results tagged by experiment name, in the
    order of ``configs``. One that fails is named in the error. With more than
    one at a time, ``run`` should read its inputs itself: DataFrames that
    threads share are planned by both at once, which Spark does not promise."""
    if not configs:
        raise ValueError("a sweep needs a configuration")
    results = run_settings(SparkSession.builder.getOrCreate(), configs, run, parallel, lambda cfg: str(cfg[name_key]))
    out = None
    for cfg, r in zip(configs, results):
        r = r.withColumn("experiment", F.lit(str(cfg[name_key])))
        out = r if out is None else out.unionByName(r)
    return out
