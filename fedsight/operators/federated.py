"""The federated loop with explanation rounds, resumable round by round.

A round selects clients, trains their nets from the global one, averages them,
measures clients and the global net and, in explanation rounds, explains a
sample of every client's rows with the client's own net, summarises, releases
(clip and noise) and aggregates the importances.

Everything a round makes is a table under ``path``/round=N/attempt-...; the
round counts once its manifest is there, a single small file that is created,
never replaced, and names the attempt. A run that is started again with the
same settings reads the manifests, takes the last round's weights and goes on;
what decays or accumulates over rounds is computed from the rounds' tables, so
nothing but ``path`` has to survive. The driver holds the nets of one block of
clients at a time.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsight.functions.constants import TEMPORAL_DECAY
from fedsight.operators import aggregate as ag
from fedsight.operators import evaluate as ev
from fedsight.operators import explain as ex
from fedsight.operators import perceptron as pc
from fedsight.operators import privacy as pv
from fedsight.operators import sample as sp
from fedsight.operators import summarize as sm
from fedsight.session import cut_lineage

AGGREGATIONS = ("simple", "weighted", "median", "trimmed")
TABLES = ("weights", "local", "client_metrics", "global_metrics", "importance", "aggregated", "agreement")


@dataclass(frozen=True)
class Explanations:
    """``rounds``: explanation rounds (None: all); ``per_client`` rows are
    explained by Kernel SHAP against ``background`` rows with ``nsamples``
    coalitions; importances are clipped and noised if ``epsilon`` is given
    (unpredictably: a resumed run then draws anew for rounds it has yet to do);
    fewer than ``min_clients`` reporting clients give no aggregate."""
    rounds: tuple[int, ...] | None = None
    per_client: int = 10
    background: int = 50
    nsamples: int = 256
    min_clients: int = 2
    aggregation: str = "simple"
    discard_outliers: bool = True
    epsilon: float | None = None
    clip: tuple[float, float] = (0.0, 1.0)

    def due(self, r: int) -> bool:
        return self.rounds is None or r in self.rounds


class Rounds:
    """The committed rounds under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self, r: int) -> str:
        return f"{self.path}/round={r}/manifest.json"

    def manifest(self, r: int) -> dict | None:
        fs, p = self._fs(self._manifest(r))
        return json.loads(self.spark.read.text(str(p), wholetext=True).first()[0]) if fs.exists(p) else None

    def commit(self, r: int, body: dict) -> None:
        """Create the manifest; if another run has committed the round, its attempt counts."""
        fs, p = self._fs(self._manifest(r))
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return
            raise
        out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        out.close()

    def done(self) -> list[dict]:
        """Manifests of rounds 1, 2, ... up to the first that is missing."""
        out = []
        while (m := self.manifest(len(out) + 1)) is not None:
            out.append(m)
        return out

    def table(self, name: str, upto: int | None = None) -> DataFrame | None:
        """The rows of all rounds that have the table, with their round."""
        out = None
        for m in self.done()[:upto]:
            if name in m["tables"]:
                one = self.spark.read.parquet(f"{self.path}/round={m['round']}/{m['attempt']}/{name}").withColumn("round", F.lit(m["round"]))
                out = one if out is None else out.unionByName(one)
        return out

    def net(self, r: int | None = None) -> pc.Net:
        """The global net after round ``r`` (default: the last)."""
        last = r or len(self.done())
        return pc.net_of(self.table("weights").where(F.col("round") == last))

    def contributions(self, upto: int | None = None) -> DataFrame:
        """G7 over the rounds so far."""
        return ev.contribution_scores(self.table("client_metrics", upto).select("client_id", "round", "auc"))

    def importances(self, decay: float = TEMPORAL_DECAY) -> DataFrame | None:
        """J7 over the aggregated rounds so far."""
        found = self.table("aggregated")
        return None if found is None else ag.temporal_decay(found.select("round", "method", "feature", "value"), decay)

    def log(self) -> DataFrame:
        """Global metrics and duration of every round."""
        rows = [(m["round"], float(m["seconds"]), int(m["clients"])) for m in self.done()]
        return self.spark.createDataFrame(rows, "round int, seconds double, clients int").join(self.table("global_metrics"), "round", "left")


def _settings(**what) -> str:
    return hashlib.md5(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


def _explained(rows: DataFrame, background: DataFrame, local: pc.Local, features: Sequence[str], key: str, r: int, e: Explanations, seed: int) -> DataFrame:
    """Client importances of the rows of the block's clients."""
    phi = ex.kernel_shap_batch(rows, background, features, key, nsamples=e.nsamples, seed=seed, by="client_id",
                               scorers={k: n.probability for k, n in local.nets.items()})
    attr = phi.select("client_id", F.lit(r).alias("round"), F.col(key).cast("string").alias("instance_id"), F.lit("shap").alias("method"), "feature",
                      F.col("phi").alias("value"))
    return sm.importance_normalised(attr)


def train(rows: DataFrame, features: Sequence[str], key: str, start: pc.Net, rounds: int, path: str, local_epochs: int = 1, lr: float = 0.1,
          l2: float = 0.0, fraction: float = 1.0, min_clients: int = 2, weighted: bool = False, class_weighted: bool = True,
          test: DataFrame | None = None, explain: Explanations | None = None, seed: int = 42, client: str = "client_id",
          label: str = "label") -> Rounds:
    """``rounds`` rounds in all, counting those already committed under ``path``
    (a cluster's machines must share it). Settings and features other than
    those of the committed rounds, too few clients and an unknown aggregation
    are errors; so are rows with null or infinite features (:func:`pc.fit`)."""
    if explain and explain.aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {explain.aggregation}")
    spark, made = rows.sparkSession, Rounds(rows.sparkSession, path)
    settings = _settings(features=list(features), start=start.flat().tolist(), shape=[t.shape for t in start.tensors], local_epochs=local_epochs, lr=lr, l2=l2,
                         fraction=fraction, weighted=weighted, class_weighted=class_weighted, explain=asdict(explain) if explain else None, seed=seed)
    done = made.done()
    if any(m["settings"] != settings for m in done):
        raise ValueError(f"{path} holds rounds of other settings")
    if len(done) >= rounds:
        return made
    rows = cut_lineage(rows.select(key, F.col(client).alias("client_id"), F.col(label).alias("label"), *features))
    clients = cut_lineage(rows.select("client_id").distinct())
    n_clients = clients.count()
    if n_clients < min_clients:
        raise ValueError(f"{n_clients} clients < min_clients {min_clients}")
    ready = pc.prepared(rows, features, "label", "client_id", class_weighted)
    if test is not None:
        test = cut_lineage(test.select(F.col(label).alias("label"), *features))
    if explain:
        sampled = cut_lineage(sp.explanation_sample(rows, "client_id", "label", [key], per_client=explain.per_client, seed=seed).select(key, "client_id", *features))
        background = cut_lineage(sp.background_sample(rows, [key], explain.background, seed))
    net = made.net() if done else start
    for r in range(len(done) + 1, rounds + 1):
        began, attempt = time.monotonic(), f"attempt-{uuid.uuid4().hex}"
        at, tables = f"{made.path}/round={r}/{attempt}", set()

        def save(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("append").parquet(f"{at}/{name}")
            tables.add(name)
            return spark.read.schema(df.schema).parquet(f"{at}/{name}")

        chosen = cut_lineage(sp.select_clients(clients.withColumn("round", F.lit(r)), "client_id", "round", fraction, seed).select("client_id"))
        taking = ready.join(chosen.withColumnRenamed("client_id", "client"), "client", "left_semi") if fraction < 1 else ready
        due = explain is not None and explain.due(r)
        local = scored = importance = None
        for block, trained in pc.local_blocks(taking, net, local_epochs, lr, l2):
            local = save("local", trained.table(spark))
            # Scores are written once and measured once all blocks are there.
            scored = save("scores", pc.score_local(block, trained.nets).select(F.col("client").alias("client_id"), F.col("y").alias("label"), "score",
                                                                              (F.col("score") > 0.5).cast("double").alias("pred")))
            if due:
                own = sampled.where(F.col("client_id").isin(list(trained.nets))) if len(trained.nets) < n_clients else sampled
                found = _explained(own, background, trained, features, key, r, explain, seed)
                if explain.epsilon is not None:
                    found = pv.laplace_noise(found, explain.epsilon, ["client_id", "feature", "method"], explain.clip, seed=seed + r)
                importance = save("importance", found.drop("round"))
        net = pc.net_of(save("weights", pc.average_tensors(local, weighted=weighted)))
        current = save("client_metrics", ev.metrics(scored, ["client_id"], digits=None))
        if test is not None:
            st = pc.score_batch(test, features, net).withColumnRenamed("prob_1", "score")
            save("global_metrics", ev.metrics(st, [], digits=None))
        else:
            save("global_metrics", spark.createDataFrame([(None, None)], "accuracy double, auc double"))
        if importance is not None:
            imp = cut_lineage(importance.withColumn("round", F.lit(r)))
            kept = ag.aggregation_gate(imp, explain.min_clients)
            kept = ag.zscore_filter(kept) if explain.discard_outliers else kept
            if explain.aggregation == "weighted":
                before = made.table("client_metrics", r - 1)
                seen = current.withColumn("round", F.lit(r))
                seen = seen if before is None else before.unionByName(seen)
                combined = ag.aggregate_weighted(kept, ev.contribution_scores(seen.select("client_id", "round", "auc")))
            else:
                combined = {"simple": ag.aggregate_simple, "median": ag.aggregate_median, "trimmed": ag.aggregate_trimmed}[explain.aggregation](kept)
            save("aggregated", combined.drop("round"))
            save("agreement", ag.agreement_spearman(imp).drop("round"))
        made.commit(r, {"round": r, "attempt": attempt, "tables": sorted(tables), "settings": settings, "clients": chosen.count(),
                        "seconds": round(time.monotonic() - began, 3)})
        net = made.net(r)                                  # the committed attempt's, should another run have been first
    return made
