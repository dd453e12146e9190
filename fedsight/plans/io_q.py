"""Queries for sinks and sources (A5-A9) and the experiment sweep (L2)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from fedsight.functions.draws import sql_uniform
from fedsight.operators import aggregate as ag
from fedsight.operators import evaluate as ev
from fedsight.operators import sample as sp
from fedsight.operators import sweep as sw
from fedsight.operators import train as tr
from fedsight.plans import features_q
from fedsight.plans.registry import query
from fedsight.plans.eval_q import _auc_sql
from fedsight.plans.train_q import CW, D, FEATS, L2, sql_avg, sql_step
from fedsight.sources import io
from fedsight.sources import testbed as tb
from fedsight.session import cut_lineage
from fedsight.sources.tables import load

IMP = tb.with_ctes(tb.SQL_IMPORTANCE)


# A5: nested per-(client, round) summaries -> JSON (one folder per pair) -> back.
@query("explanation_json_roundtrip", IMP + "SELECT client_id, round, method, feature, value FROM importance")
def q_expl_json(spark, d):
    path = io.fresh_path(spark, "explanations")
    io.write_summaries_json(io.nest_summaries(tb.importance(spark, d)), path)
    return io.unnest_summaries(io.read_summaries_json(spark, path))


# Two runs appended to one history folder; the reload picks the latest run.
@query("history_json_roundtrip", IMP + """
SELECT round, method, feature, round(median(value), 9) AS value FROM importance GROUP BY ALL""")
def q_history_json(spark, d):
    path = io.fresh_path(spark, "history")
    imp = tb.importance(spark, d)
    io.write_history_json(ag.aggregate_simple(imp), path, "run-0001")
    io.write_history_json(ag.aggregate_median(imp), path, "run-0002")
    return io.read_history_json(spark, path).withColumn("value", F.round("value", 9))


# Per-experiment round history written partitioned by experiment and reloaded.
@query("experiment_results_table", tb.with_ctes(tb.SQL_SCORED) + """
SELECT 'threshold_0.5' AS experiment, round, round(avg(CAST(pred = label AS DOUBLE)), 9) AS accuracy FROM scored GROUP BY round
UNION ALL
SELECT 'threshold_0.4', round, round(avg(CAST(CAST(score > 0.4 AS INTEGER) = label AS DOUBLE)), 9) FROM scored GROUP BY round""")
def q_results_table(spark, d):
    s = tb.scored(spark, d)
    a = s.groupBy("round").agg(ev.accuracy_expr().alias("accuracy")).withColumn("experiment", F.lit("threshold_0.5"))
    b = (s.withColumn("pred", (F.col("score") > 0.4).cast("int")).groupBy("round")
         .agg(ev.accuracy_expr().alias("accuracy")).withColumn("experiment", F.lit("threshold_0.4")))
    path = io.fresh_path(spark, "results")
    io.save_results(a.unionByName(b).withColumn("accuracy", F.round("accuracy", 9)), path)
    return spark.read.parquet(path).select("experiment", "round", "accuracy")


# The feature table of a stratified 40 % of the admissions, materialised under md5("mortality_0.4") and read through.
_U_ADM = sql_uniform(["hadm_id"], 42)
_KEPT = f"""kept AS (
  SELECT hadm_id FROM (SELECT hadm_id, row_number() OVER (PARTITION BY expire_flag ORDER BY {_U_ADM}, hadm_id) AS rn,
    count(*) OVER (PARTITION BY expire_flag) AS n FROM admissions) WHERE rn <= round(n * 0.4)),
base AS ("""


@query("feature_cache_key", features_q.FEATURE_TABLE_SQL.replace("base AS (", _KEPT, 1)
       .replace("FROM admissions a LEFT JOIN patients", "FROM (SELECT * FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM kept)) a LEFT JOIN patients", 1)
       .replace("SELECT base.hadm_id,", "SELECT md5('mortality_0.4') AS cache_key, base.hadm_id,", 1))
def q_cache(spark, d):
    fraction = 0.4

    def build():
        part = sp.stratified_subsample(tb.admissions(spark, d), "expire_flag", fraction, ["hadm_id"], seed=42)
        return features_q.build_feature_table(spark, d, part)

    # the cache root names the input files as they are now and the table's definition
    state = "".join(io.input_state(load(spark, d, t)) for t in ("orders", "customer", "lineitem"))
    root = io.shared_path(spark, "feature-cache", hashlib.md5((state + features_q.FEATURE_TABLE_SQL).encode()).hexdigest())
    t = io.cached_table(spark, "mortality", fraction, build, root=root)
    return t.withColumn("cache_key", F.lit(io.cache_key("mortality", fraction)))


# L2: three federated configurations over the same rows; per
# experiment and round the global accuracy / AUC on a stratified 20 % test part.
SWEEP_CONFIGS = [
    {"name": "lr_0.5_e1", "lr": 0.5, "local_epochs": 1, "fraction": 1.0},
    {"name": "lr_0.1_e2", "lr": 0.1, "local_epochs": 2, "fraction": 1.0},
    {"name": "lr_0.5_half", "lr": 0.5, "local_epochs": 1, "fraction": 0.67},
]


def _sweep_sql() -> str:
    """The sweep with its rounds and epochs unrolled."""
    rows = tb.with_ctes(tb.sql_training_rows()).rstrip().replace("training_rows AS", "all_rows AS", 1)
    split = """,
sp_cc AS (SELECT label, count(*) AS n_class FROM all_rows GROUP BY 1),
sp_e AS (SELECT label, n_class * ceil(0.2 * sum(n_class) OVER ()) / sum(n_class) OVER () AS ex, ceil(0.2 * sum(n_class) OVER ()) AS nt FROM sp_cc),
sp_p AS (SELECT label, floor(ex) AS fl, nt - sum(floor(ex)) OVER () AS left_, row_number() OVER (ORDER BY ex - floor(ex) DESC, label) AS pos FROM sp_e),
sp_q AS (SELECT label, fl + CASE WHEN pos <= left_ THEN 1 ELSE 0 END AS quota FROM sp_p),
sp_r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY """ + sql_uniform(["vec_id"], 42) + """, vec_id) AS rn FROM all_rows),
test_rows AS (SELECT sp_r.* FROM sp_r JOIN sp_q USING (label) WHERE rn <= quota),
training_rows AS (SELECT sp_r.* FROM sp_r JOIN sp_q USING (label) WHERE rn > quota),
""" + CW
    out, finals = rows + split, []
    for k, cfg in enumerate(SWEEP_CONFIGS):
        glob = None
        for r in (1, 2):
            n = f"x{k}_{r}"
            draw = sql_uniform(["client_id", f"CAST({r} AS INTEGER)"], 42)
            start = (", ".join(f"0.0 AS w{i}" for i in range(D)) + ", 0.0 AS b") if glob is None else (
                ", ".join(f"(SELECT w{i} FROM {glob}) AS w{i}" for i in range(D)) + f", (SELECT b FROM {glob}) AS b")
            out += f""",
{n}_c AS (SELECT client_id, row_number() OVER (ORDER BY {draw}, client_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT client_id FROM training_rows)),
{n}_e0 AS (SELECT client_id, {start} FROM {n}_c WHERE rn <= greatest(1, floor(n * {cfg["fraction"]})))"""
            for e in range(cfg["local_epochs"]):
                out += ",\n" + sql_step(f"{n}_e{e}", f"{n}_e{e + 1}", lr=cfg["lr"])
            glob = f"{n}_g"
            out += ",\n" + sql_avg(f"{n}_e{cfg['local_epochs']}", glob)
            margin = " + ".join(f"t.f{i} * g.w{i}" for i in range(D)) + " + g.b"
            out += f""",
{n}_t AS (SELECT t.label, 1.0 / (1.0 + exp(-({margin}))) AS score FROM test_rows t, {glob} g)"""
            finals.append(f"""SELECT '{cfg["name"]}' AS experiment, {r} AS round,
  (SELECT round(avg(CAST(CAST(score > 0.5 AS INTEGER) = label AS DOUBLE)), 6) FROM {n}_t) AS accuracy,
  (SELECT round(auc, 6) FROM {_auc_sql([], f"{n}_t")}) AS auc""")
    return out + "\n" + "\nUNION ALL\n".join(finals)


@query("experiment_sweep", _sweep_sql())
def q_sweep(spark, d):
    rows = cut_lineage(sp.stratified_split(tb.training_rows(spark, d), "label", ["vec_id"], 0.2, seed=42))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")

    def run(cfg):
        r = tr.fedavg_train(train, FEATS, rounds=2, fraction=float(cfg["fraction"]),
                            local_epochs=int(cfg["local_epochs"]), lr=float(cfg["lr"]), l2=L2, test=test)
        return r.global_metrics

    return sw.run_sweep(SWEEP_CONFIGS, run).select("experiment", "round", F.round("accuracy", 6).alias("accuracy"), F.round("auc", 6).alias("auc"))
