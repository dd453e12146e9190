"""End-to-end flows of the reference (rows checks): the central run and the
federated run, composed from the operators on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsight.operators import aggregate as ag
from fedsight.operators import clean
from fedsight.operators import evaluate as ev
from fedsight.operators import explain as ex
from fedsight.operators import features as ft
from fedsight.operators import sample as sp
from fedsight.operators import summarize as sm
from fedsight.operators import train as tr
from fedsight.plans.registry import query
from fedsight.session import cut_lineage
from fedsight.sources import testbed as tb

ID, LABEL = "hadm_id", "mortality"


def _long(df, section, key_cols, value_col):
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]) if key_cols else F.lit("")
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.col(value_col).cast("double").alias("value"))


@query("central_run")
def q_central_run(spark, d):
    """40 % stratified sample -> scans restricted to the sample -> feature table
    -> 80/20 split -> class-weighted logistic fit -> test metrics -> Kernel SHAP
    (sampled coalitions) for a balanced handful of test rows."""
    sampled = sp.stratified_subsample(tb.admissions(spark, d), "expire_flag", 0.4, [ID])
    sampled = cut_lineage(sampled)      # the keys are read three times
    keys = sampled.select(ID)
    table = ft.feature_table(
        sampled, tb.patients(spark, d), ft.restrict_to_keys(tb.measurements(spark, d), keys, ID),
        ft.restrict_to_keys(tb.diagnoses(spark, d), keys, ID), lab_items=tb.LAB_ITEMS,
        vital_items=tb.VITAL_ITEMS, code_prefixes=tb.CODE_PREFIXES, top_n=10)
    feats = [c for c in table.columns if c not in (ID, LABEL)]
    split = sp.stratified_split(table, LABEL, [ID], 0.2)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    # the prepared, standardised parts are materialised once (as a real run would)
    train_z = cut_lineage(clean.standardize(train, feats))
    test_z = cut_lineage(clean.standardize(test, feats, fit_on=train))
    model = tr.fit_classifier(train_z, feats, LABEL, max_iter=50)
    scored = tr.predict(model, test_z, feats).withColumnRenamed(LABEL, "label")
    report = ev.classification_report(scored)
    auc = ev.roc_auc(scored)
    w, b = [float(v) for v in model.coefficients], float(model.intercept)
    inst = sp.balanced_sample(test_z, LABEL, [ID], 4)
    bg = sp.background_sample(train_z, [ID], 50)
    phi = ex.kernel_shap_batch(inst, bg, feats, ID, w, b, nsamples=512)
    return (_long(report.select("class", F.col("f1")), "f1", ["class"], "f1")
            .unionByName(_long(auc, "auc", [], "auc"))
            .unionByName(_long(phi, "phi", [ID, "feature"], "phi")))


@query("federated_run")
def q_federated_run(spark, d):
    """Feature table -> Dirichlet client partition -> split -> 3 FedAvg rounds
    with held-out metrics -> per-client explanation samples -> linear SHAP ->
    client importance summaries -> gate, outlier filter, average, agreement."""
    from fedsight.plans.features_q import build_feature_table
    table = build_feature_table(spark, d)
    feats = [c for c in table.columns if c not in (ID, LABEL) and not c.endswith("_category")]
    parted = sp.partition_clients(table, [ID], 3)
    split = cut_lineage(sp.stratified_split(parted, LABEL, [ID], 0.2))      # both parts are read many times
    train = split.where("split = 'train'").withColumnRenamed(LABEL, "label")
    test = split.where("split = 'test'").withColumnRenamed(LABEL, "label")
    train_z = clean.standardize(train, feats)       # the loop writes the columns that it reads
    test_z = clean.standardize(test, feats, fit_on=train)
    run = tr.fedavg_train(train_z, feats, rounds=3, local_epochs=2, lr=0.5, l2=0.01, test=test_z)
    g = run.model.first()
    w, b = list(g["_w"]), float(g["_b"])
    expl = sp.explanation_sample(train_z, "client_id", "label", [ID], per_client=10)
    bg = sp.background_sample(train_z, [ID], 100)
    phi = ex.linear_shap(expl, feats, ID, w, b, bg)
    attr = phi.join(expl.select(ID, "client_id"), ID).select(
        "client_id", F.lit(3).alias("round"), F.col(ID).alias("instance_id"), F.lit("shap").alias("method"),
        "feature", F.col("phi").alias("value"))
    imp = sm.importance_normalised(attr)
    agg = ag.aggregate_simple(ag.zscore_filter(ag.aggregation_gate(imp, min_clients=2)))
    agree = ag.agreement_spearman(imp)
    return (_long(run.global_metrics, "auc", ["round"], "auc")
            .unionByName(_long(run.contributions, "contribution", ["client_id"], "contribution_score"))
            .unionByName(_long(agg, "importance", ["feature"], "value"))
            .unionByName(_long(agree, "agreement", ["client_a", "client_b"], "agreement")))
