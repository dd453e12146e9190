"""Evaluation and training analytics (G1-G13) on scored tables.

A scored table has a label (0/1), a score in [0, 1] and a predicted class;
every metric is a grouped aggregate so it can be computed per client, per
round or per experiment in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedsight.functions.constants import CONTRIBUTION_DECAY, CONTRIBUTION_MISSING_AUC
from fedsight.functions.draws import uniform
from fedsight.functions.rank import ordered_totals, top_k_per_group


# G1 -----------------------------------------------------------------------------
def accuracy_expr(label: str = "label", pred: str = "pred") -> Column:
    return F.avg((F.col(pred) == F.col(label)).cast("double"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(accuracy_expr(label, pred).alias("accuracy"))


# G2 -----------------------------------------------------------------------------
def _collapsed(df: DataFrame, g: list, label: str, score: str, pred: str | None) -> DataFrame:
    aggs = [F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")]
    if pred is not None:
        aggs += [F.count_if(F.col(pred) == F.col(label)).alias("_ok"), F.count(F.lit(1)).alias("_rows")]
    return df.groupBy(*g, F.col(score).alias("_s")).agg(*aggs)


def _auc_from_collapsed(c: DataFrame, g: list, buckets: int | None, with_accuracy: bool) -> DataFrame:
    c = ordered_totals(c, [*g, "_s"], "_neg", g, partitions=buckets)
    aggs = [F.sum(F.col("_pos") * (F.col("before__neg") + F.col("_neg") / 2.0)).alias("_u"),
            F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N")]
    if with_accuracy:
        aggs += [(F.sum("_ok") / F.sum("_rows")).alias("accuracy")]
    agg = c.groupBy(*g).agg(*aggs)
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_u") / (F.col("_P") * F.col("_N")))
    return agg.select(*g, *(["accuracy"] if with_accuracy else []), auc.alias("auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (),
            buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC with ties (Mann-Whitney): rows collapse to distinct
    (group, score) with positive/negative counts (partial aggregation, so a hot
    group is merged from per-task partials); the negatives below each score
    come from bucketed running totals; AUC = Σ pos·(neg_below + neg_tied/2)
    / (P·N); null when a group has only one class."""
    g = list(by)
    return _auc_from_collapsed(_collapsed(df, g, label, score, None), g, buckets, False)


def metrics(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score",
            pred: str = "pred", digits: int | None = 6) -> DataFrame:
    """Accuracy and AUC per group from ONE pass over the rows (the
    correct-prediction counts ride along in the score collapse)."""
    g = list(by)
    out = _auc_from_collapsed(_collapsed(df, g, label, score, pred), g, None, True)
    if digits is not None:
        out = out.withColumns({"accuracy": F.round("accuracy", digits), "auc": F.round("auc", digits)})
    return out


# G3 -----------------------------------------------------------------------------
def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Long (actual, predicted, n) grid with all four cells, zero-filled."""
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    wide = df.groupBy(*by).agg(*[F.count_if((F.col(label) == a) & (F.col(pred) == p)).alias(f"c{a}{p}")
                                 for a, p in cells])
    stack = ", ".join(f"{a}, {p}, c{a}{p}" for a, p in cells)
    return wide.selectExpr(*by, f"stack(4, {stack}) AS (actual, predicted, n)")


# G4 -----------------------------------------------------------------------------
def classification_report(df: DataFrame, label: str = "label", pred: str = "pred",
                          by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """precision / recall / f1 / support per class, then accuracy, macro and
    weighted averages (0/0 -> 0)."""
    g = list(by)
    w = df.groupBy(*g).agg(*[F.count_if((F.col(label) == a) & (F.col(pred) == p)).alias(f"c{a}{p}")
                             for a in (0, 1) for p in (0, 1)])

    def safe(n, d):
        return F.when(d > 0, n / d).otherwise(F.lit(0.0))

    def cls(k):
        tp = F.col(f"c{k}{k}").cast("double")
        fp = F.col(f"c{1 - k}{k}").cast("double")
        fn = F.col(f"c{k}{1 - k}").cast("double")
        p, r = safe(tp, tp + fp), safe(tp, tp + fn)
        return p, r, safe(2 * p * r, p + r), (tp + fn)

    (p0, r0, f0, s0), (p1, r1, f1, s1) = cls(0), cls(1)
    tot = s0 + s1
    acc = safe(F.col("c00") + F.col("c11"), tot)
    rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
            ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, tot),
            ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
            ("weighted avg", safe(p0 * s0 + p1 * s1, tot), safe(r0 * s0 + r1 * s1, tot),
             safe(f0 * s0 + f1 * s1, tot), tot)]
    cells = [F.struct(F.lit(n).alias("class"), F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"),
                      F.round(f, digits).alias("f1"), s.cast("long").alias("support")) for n, p, r, f, s in rows]
    return w.select(*g, F.explode(F.array(*cells)).alias("_x")).select(*g, "_x.*")


# G7 -----------------------------------------------------------------------------
def contribution_scores(client_round_auc: DataFrame, client: str = "client_id", round_col: str = "round",
                        auc: str = "auc", decay: float = CONTRIBUTION_DECAY,
                        missing_auc: float = CONTRIBUTION_MISSING_AUC, init: float = 1.0) -> DataFrame:
    """s <- decay*s + (1-decay)*auc over the rounds a client took part in,
    starting from ``init``: closed form decay^n*init + Σ (1-decay)·decay^(n-i)·auc_i."""
    w = Window.partitionBy(client).orderBy(round_col)
    d = client_round_auc.withColumn("_i", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(client)))
    a = F.coalesce(F.col(auc), F.lit(missing_auc))
    term = F.lit(1 - decay) * a * F.pow(F.lit(decay), F.col("_n") - F.col("_i"))
    return d.groupBy(client).agg(
        (F.pow(F.lit(decay), F.max("_n")) * F.lit(init) + F.sum(term)).alias("contribution_score"),
        F.max(round_col).alias("last_update"), F.max("_n").alias("n_rounds"))


# G8 -----------------------------------------------------------------------------
def training_summary(rows: DataFrame, client_round_auc: DataFrame, client: str = "client_id",
                     round_col: str = "round", explanations: DataFrame | None = None) -> DataFrame:
    """Client registry (data size) with contribution score, last update, rounds
    taken part in and whether explanations were collected."""
    reg = rows.groupBy(client).agg(F.count(F.lit(1)).alias("data_size"))
    sc = contribution_scores(client_round_auc, client, round_col)
    out = reg.join(sc, client, "left").select(
        client, "data_size", F.coalesce("contribution_score", F.lit(1.0)).alias("contribution_score"),
        F.coalesce("last_update", F.lit(0)).alias("last_update"),
        F.coalesce("n_rounds", F.lit(0)).cast("long").alias("n_rounds"))
    if explanations is not None:
        ex = explanations.select(client).distinct().withColumn("has_explanations", F.lit(True))
        out = out.join(ex, client, "left").withColumn("has_explanations", F.coalesce("has_explanations", F.lit(False)))
    return out


# G9 / G10 ---------------------------------------------------------------------------
def round_grid(keys: DataFrame, key_cols: Sequence[str], rounds_from: DataFrame, round_col: str = "round") -> DataFrame:
    """Every key paired with every round 1..max(round) (explode of a sequence;
    the output size is keys x rounds by definition)."""
    hi = rounds_from.agg(F.max(round_col).alias("hi")).scalar()
    return keys.select(*key_cols).distinct().select(*key_cols, F.explode(F.sequence(F.lit(1), hi)).alias(round_col))


def client_series(per_client_round: DataFrame, metric: str, client: str = "client_id",
                  round_col: str = "round") -> DataFrame:
    grid = round_grid(per_client_round, [client], per_client_round, round_col)
    return grid.join(per_client_round.select(client, round_col, metric), [client, round_col], "left").select(
        client, round_col, F.coalesce(F.col(metric), F.lit(0.0)).alias(metric))


def training_curve(per_round: DataFrame, cols: Sequence[str], round_col: str = "round") -> DataFrame:
    grid = per_round.agg(F.max(round_col).alias("_hi")).select(
        F.explode(F.sequence(F.lit(1), F.col("_hi"))).alias(round_col))
    return grid.join(per_round, round_col, "left").select(
        round_col, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])


# G11 -------------------------------------------------------------------------------
def privacy_impact(results: DataFrame, level: str, metric: str) -> DataFrame:
    return (results.where(F.col(metric).isNotNull()).groupBy(level)
            .agg(F.avg(metric).alias(metric), F.count(F.lit(1)).alias("n_runs")))


# G12 -------------------------------------------------------------------------------
def misclassified_sample(df: DataFrame, keys: Sequence[str], k: int, client: str = "client_id",
                         label: str = "label", pred: str = "pred", seed: int = 42) -> DataFrame:
    """Per client min(k, n_wrong) misclassified rows, chosen by hash draw."""
    wrong = df.where(F.col(pred) != F.col(label)).withColumn("_u", uniform(client, *keys, seed=seed))
    r = top_k_per_group(wrong, [client], "_u", keys, k)
    return r.select(*df.columns, F.col(label).alias("true_label"),
                                            F.col(pred).alias("predicted_label")).drop(label, pred)


def explain_misclassified(sample: DataFrame, phi: DataFrame, keys: Sequence[str], top: int = 5) -> DataFrame:
    """The sampled misclassified rows with their ``top`` attributions by |phi|
    (rows without an attribution stay, with nulls)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("phi")), F.asc("feature"))     # the features of one instance
    ranked = phi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return sample.join(ranked.select(*keys, "feature", "phi", "rank"), list(keys), "left")


# G13 -------------------------------------------------------------------------------
def final_metrics(history: DataFrame, group: str = "experiment", round_col: str = "round",
                  cols: Sequence[str] = ("accuracy", "auc")) -> DataFrame:
    return history.groupBy(group).agg(*[F.max_by(c, round_col).alias(f"final_{c}") for c in cols],
                                      F.max(round_col).alias("rounds"))


def compare_runs(a: DataFrame, b: DataFrame, on: str, metric: str, digits: int = 6) -> DataFrame:
    """Run-vs-run by ``on`` with the difference b - a."""
    x = a.select(on, F.col(metric).alias("_a"))
    y = b.select(on, F.col(metric).alias("_b"))
    return x.join(y, on).select(on, F.round("_a", digits).alias(f"{metric}_a"),
                                F.round("_b", digits).alias(f"{metric}_b"),
                                F.round(F.col("_b") - F.col("_a"), digits).alias("delta"))
