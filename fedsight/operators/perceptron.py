"""Perceptrons on Spark: batch scoring, weighted training with a validation
stop, local training per client and averaging of named tensors (F2, F4-F6, F8).

A net is a list of tensors, one a layer, each (inputs + 1) x outputs with the
biases as the last row; hidden layers are rectified, the output is a
probability. As a table it is long: (layer, row, col, value), with the biases
in row ``inputs``, so averaging is one grouped mean and the first layer's rows
are the features.

One step is one pass: every task adds up the gradients (and losses) of its rows
for each client it meets, and the parts are summed in a tree
(:mod:`fedsight.functions.tensors`). A client with a third of all rows is
spread over as many tasks as its rows are. The driver holds nets, never rows.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsight.functions.tensors import packed, tree_sum, unpacked
from fedsight.operators import sample as sp
from fedsight.session import cut_lineage

# Functions that run in tasks travel in the closure: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of nets that the driver and a task hold at a time; clients beyond it are trained in blocks.
MAX_NET_BYTES = 64 << 20
#: What rides along with a gradient: rows, weighted loss, plain loss, right predictions.
N_SUMS = 4
LONG = "layer int, row int, col int, value double"

Scorer = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Net:
    tensors: tuple[np.ndarray, ...]

    @property
    def n_inputs(self) -> int:
        return len(self.tensors[0]) - 1

    @property
    def size(self) -> int:
        return sum(t.size for t in self.tensors)

    def flat(self) -> np.ndarray:
        return np.concatenate([t.ravel() for t in self.tensors])

    def shaped(self, flat: np.ndarray) -> "Net":
        """A net of this one's shape with the given numbers."""
        ends = np.cumsum([t.size for t in self.tensors])
        return Net(tuple(x.reshape(t.shape) for x, t in zip(np.split(np.asarray(flat, dtype=float), ends[:-1]), self.tensors)))

    def layers(self, X: np.ndarray) -> list[np.ndarray]:
        """Inputs of every layer, then the output's margin."""
        out = [X]
        for i, t in enumerate(self.tensors):
            z = out[-1] @ t[:-1] + t[-1]
            out.append(np.maximum(z, 0) if i < len(self.tensors) - 1 else z)
        return out

    def probability(self, X: np.ndarray) -> np.ndarray:
        """Probability of class 1 for the rows of a matrix (the scoring contract)."""
        return 1 / (1 + np.exp(-np.clip(self.layers(X)[-1][:, 0], -700, 700)))

    def sums(self, X: np.ndarray, y: np.ndarray, c: np.ndarray, gradient: bool = True) -> np.ndarray:
        """Gradient of the weighted cross-entropy summed over the rows (zeros
        without ``gradient``), then the N_SUMS numbers that ride along."""
        a = self.layers(X)
        margin = np.clip(a[-1][:, 0], -700, 700)
        loss = np.logaddexp(0, margin) - y * margin
        p = 1 / (1 + np.exp(-margin))
        rides = [len(y), float(c @ loss), float(loss.sum()), float(((p > 0.5) == (y > 0.5)).sum())]
        if not gradient:
            return np.concatenate((np.zeros(self.size), rides))
        back, grads = (c * (p - y))[:, None], []
        for i in range(len(self.tensors) - 1, -1, -1):
            grads.append(np.vstack((a[i].T @ back, back.sum(axis=0))).ravel())
            if i:
                back = (back @ self.tensors[i][:-1].T) * (a[i] > 0)
        return np.concatenate((*reversed(grads), rides))

    def penalty(self) -> np.ndarray:
        """The weights without biases, as a flat vector: the slope of half their squares."""
        return np.concatenate([np.vstack((t[:-1], np.zeros((1, t.shape[1])))).ravel() for t in self.tensors])


def initial(sizes: Sequence[int], seed: int = 42) -> Net:
    """Normal weights of variance 2 / inputs (He et al. 2015), no bias."""
    rng = np.random.default_rng(seed)
    return Net(tuple(np.vstack((rng.normal(0, np.sqrt(2 / n), (n, m)), np.zeros((1, m)))) for n, m in zip(sizes[:-1], sizes[1:])))


# F4 ------------------------------------------------------------------------------
def score_batch(df: DataFrame, features: Sequence[str], scorer: Scorer | Net, threshold: float = 0.5) -> DataFrame:
    """``df`` with prob_1, prob_0 and pred (prob_1 > ``threshold``) of any model:
    a net, or a function from a matrix of rows to the probabilities of class 1.

    One Arrow pass; the model travels in the closure. A net of another width than
    ``features`` is an error at once; null, NaN and infinite features, and a
    scorer that gives another number of values than rows or values outside
    0 to 1, are errors of the job.
    """
    if isinstance(scorer, Net):
        if scorer.n_inputs != len(features):
            raise ValueError(f"the net takes {scorer.n_inputs} features, {len(features)} are given")
        scorer = scorer.probability

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([x.to_numpy(dtype=float, na_value=np.nan) for x in cols])
        if not np.isfinite(X).all():
            raise ValueError("features must not be null, NaN or infinite")
        p = np.asarray(scorer(X), dtype=float)
        if p.shape != (len(X),) or not ((p >= 0) & (p <= 1)).all():
            raise ValueError("a scorer gives one probability a row")
        return pd.Series(p)

    p = score(*[F.col(f).cast("double") for f in features])
    return df.withColumn("prob_1", p).withColumn("prob_0", 1 - F.col("prob_1")).withColumn("pred", (F.col("prob_1") > threshold).cast("int"))


# training passes -------------------------------------------------------------------
def prepared(rows: DataFrame, features: Sequence[str], label: str, client: str | None = None, class_weighted: bool = True,
             held: str | None = None) -> DataFrame:
    """Checkpointed (client, held, y, c, x) of the rows, read once by every pass:
    the class weight is that of the client's rows (n / (classes x rows of the class))."""
    d = rows.select((F.col(client) if client else F.lit("all")).alias("client"), (F.col(held) if held else F.lit(False)).alias("held"),
                    F.col(label).cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    d = cut_lineage(d)
    if not class_weighted:
        return d.withColumn("c", F.lit(1.0))
    per = d.groupBy("client", "y").agg(F.count(F.lit(1)).alias("_ny"))
    total = per.groupBy("client").agg(F.sum("_ny").alias("_n"), F.count(F.lit(1)).alias("_k"))
    weights = per.join(total, "client").select("client", "y", (F.col("_n") / (F.col("_k") * F.col("_ny"))).alias("c"))
    return cut_lineage(d.join(weights, ["client", "y"]).select("client", "held", "y", "c", "x"))


def _sums(rows: DataFrame, nets: Net | dict, gradient: bool = True) -> dict:
    """{(client, held): summed gradient and rides} of :func:`prepared` rows, each
    scored by its client's net (or by the one net); held rows have no gradient."""
    some = nets if isinstance(nets, Net) else next(iter(nets.values()))
    width, room = some.n_inputs, max(1, MAX_NET_BYTES // (8 * (some.size + N_SUMS)))
    kind = rows.schema["client"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), {}

        def flush() -> pa.RecordBatch:
            keys = list(total)
            out = [pa.array([k for k, _ in keys], clients), pa.array([h for _, h in keys]), pa.array([part] * len(keys), pa.int64()),
                   pa.array([packed(total[k]) for k in keys], pa.binary())]
            total.clear()
            return pa.RecordBatch.from_arrays(out, ["client", "held", "part", "value"])

        for batch in batches:
            clients = batch.column("client").type
            y, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("y", "c"))
            lists = batch.column("x")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat) != width * len(lists) or not np.isfinite(flat).all() or not np.isfinite(y).all():
                raise ValueError(f"rows need a label and {width} features that are not null, NaN or infinite")
            X = flat.reshape(-1, width)
            names, code = np.unique(batch.column("client").to_numpy(zero_copy_only=False), return_inverse=True)
            group = code * 2 + batch.column("held").to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                if len(at):
                    key = (names[group[at[0]] // 2].item() if hasattr(names[0], "item") else names[group[at[0]] // 2], bool(group[at[0]] % 2))
                    net = nets if isinstance(nets, Net) else nets[key[0]]
                    total[key] = total.get(key, 0) + net.sums(X[at], y[at], c[at], gradient and not key[1])
            if len(total) >= room:
                yield flush()
        if total:
            yield flush()

    parts = rows.select("client", "held", "y", "c", "x").mapInArrow(run, f"client {kind.simpleString()}, held boolean, part bigint, value binary")
    summed = tree_sum(parts, ["client", "held"], rows.rdd.getNumPartitions())
    return {(r["client"], r["held"]): unpacked(r["value"]) for r in summed.collect()}       # nets of one block of clients


def _stepped(net: Net, sums: np.ndarray, lr: float, l2: float) -> Net:
    """One full-batch step: w - lr (gradient / rows + l2 w), biases without l2."""
    g = sums[:net.size] / sums[net.size]
    return net.shaped(net.flat() - lr * (g + l2 * net.penalty()))


# F2 ------------------------------------------------------------------------------
@dataclass(frozen=True)
class Fit:
    """``net``: the weights of the epoch with the least validation loss (of the
    last one without validation rows); ``log``: a row an epoch."""
    net: Net
    best_epoch: int
    log: list[tuple]

    LOG = ("epoch int, train_loss double, validation_loss double, train_accuracy double, validation_accuracy double, seconds double")

    def log_table(self, spark: SparkSession) -> DataFrame:
        """The epochs' values and durations."""
        return spark.createDataFrame(self.log, self.LOG)


def fit(train: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label", hidden: Sequence[int] = (32, 16), epochs: int = 100,
        lr: float = 0.01, l2: float = 0.0, validation: float = 0.2, patience: int = 20, class_weighted: bool = True,
        optimiser: str = "adam", start: Net | None = None, seed: int = 42) -> Fit:
    """Class-weighted training with a validation stop, one distributed pass an epoch.

    The last ``validation`` of the rows in ``keys`` order (E9) are held out;
    class weights are those of all rows. Each pass gives the gradient over the
    training rows and, at the same weights, both losses (weighted cross-entropy
    on training rows, plain on held-out ones) and accuracies. Training ends when
    the validation loss has not fallen for ``patience`` epochs; the best weights
    come back. ``optimiser``: adam (Kingma & Ba 2015) or sgd, on the full batch.
    No rows, null labels or features that are not finite are errors.
    """
    if optimiser not in ("adam", "sgd"):
        raise ValueError(f"unknown optimiser {optimiser}")
    held = sp.validation_holdout(train.select(*keys, label, *features), list(keys), validation, "_held") if validation else train.withColumn("_held", F.lit(False))
    rows = prepared(held, features, label, None, class_weighted, "_held")
    net = start or initial([len(features), *hidden, 1], seed)
    best, best_loss, best_epoch, log = net, np.inf, 0, []
    m, v = np.zeros(net.size), np.zeros(net.size)
    for epoch in range(1, epochs + 1):
        began = time.monotonic()
        sums = _sums(rows, net)
        own, away = sums.get(("all", False)), sums.get(("all", True))
        if own is None:
            raise ValueError("there are no training rows")
        n, weighted, _, right = map(float, own[net.size:])
        val_n, _, val_loss, val_right = map(float, away[net.size:]) if away is not None else (1.0, None, None, None)
        if away is not None:
            val_loss, val_right = val_loss / val_n, val_right / val_n
        now = weighted / n if val_loss is None else val_loss
        if val_loss is None or now < best_loss:
            best, best_loss, best_epoch = net, now, epoch
        if optimiser == "sgd":
            net = _stepped(net, own, lr, l2)
        else:
            g = own[:net.size] / n + l2 * net.penalty()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            net = net.shaped(net.flat() - lr * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.999 ** epoch)) + 1e-8))
        log.append((epoch, weighted / n, val_loss, right / n, val_right, time.monotonic() - began))
        if val_loss is not None and epoch - best_epoch >= patience:
            break
    return Fit(best if validation else net, best_epoch, log)


# F5 ------------------------------------------------------------------------------
@dataclass(frozen=True)
class Local:
    """Nets and numbers of rows of clients after local training."""
    nets: dict
    sizes: dict

    def table(self, spark: SparkSession) -> DataFrame:
        """(client_id, data_size, layer, row, col, value)."""
        return long_table(spark, self.nets, sizes=self.sizes)


def local_blocks(rows: DataFrame, start: Net | dict, local_epochs: int = 1, lr: float = 0.1, l2: float = 0.0) -> Iterator[tuple[DataFrame, Local]]:
    """The rows and trained clients of one block after another; a block is
    as many clients as MAX_NET_BYTES holds nets of, by equal hashes."""
    some = start if isinstance(start, Net) else next(iter(start.values()))
    clients = rows.agg(F.count_distinct("client")).first()[0]
    blocks = max(1, -(-clients * 8 * (some.size + N_SUMS) // MAX_NET_BYTES))
    for b in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("client"), F.lit(blocks)) == b)
        own, sizes = start, {}
        for _ in range(local_epochs):
            sums = _sums(block, own)
            names = {k for k, _ in sums}
            before = own if isinstance(own, dict) else dict.fromkeys(names, own)
            own = {k: _stepped(before[k], sums[k, False], lr, l2) if (k, False) in sums else before[k] for k in names}
            sizes = {k: int(sums[k, False][some.size]) if (k, False) in sums else 0 for k in names}
            if not own:
                break
        if isinstance(own, dict) and own:
            yield block, Local(own, sizes)


def local_train(rows: DataFrame, start: Net | dict, local_epochs: int = 1, lr: float = 0.1, l2: float = 0.0) -> Local:
    """``local_epochs`` full-batch steps of every client of :func:`prepared` rows
    from ``start`` (one net, or a net a client): one pass an epoch for all
    clients of a block together. Held rows are not learned from; a client with
    held rows only keeps its start. All nets come back at once; a caller with
    more clients than memory takes :func:`local_blocks`."""
    nets, sizes = {}, {}
    for _, done in local_blocks(rows, start, local_epochs, lr, l2):
        nets.update(done.nets)
        sizes.update(done.sizes)
    return Local(nets, sizes)


def score_local(rows: DataFrame, nets: dict) -> DataFrame:
    """(client, y, score) of :func:`prepared` rows by their clients' nets."""
    kind = rows.schema["client"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, X = batch.column("client").to_pylist(), np.array(batch.column("x").to_pylist(), dtype=float)
            score = np.zeros(len(who))
            for k in set(who):
                at = np.flatnonzero([w == k for w in who])
                score[at] = nets[k].probability(X[at])
            yield pa.RecordBatch.from_arrays([batch.column("client"), batch.column("y"), pa.array(score)], ["client", "y", "score"])

    return rows.select("client", "y", "x").mapInArrow(run, f"client {kind}, y double, score double")


# F6 / F8 ---------------------------------------------------------------------------
def long_table(spark: SparkSession, nets: Net | dict, client: str = "client_id", sizes: dict | None = None) -> DataFrame:
    """(layer, row, col, value) of a net, or the same a client (with data_size if given)."""
    def cells(net: Net):
        return [(i, r, c, float(x)) for i, t in enumerate(net.tensors) for r, line in enumerate(t) for c, x in enumerate(line)]
    if isinstance(nets, Net):
        return spark.createDataFrame(cells(nets), LONG)
    kind = "long" if nets and isinstance(next(iter(nets)), int) else "string"
    if sizes is None:
        return spark.createDataFrame([(k, *x) for k, n in nets.items() for x in cells(n)], f"{client} {kind}, {LONG}")
    return spark.createDataFrame([(k, sizes[k], *x) for k, n in nets.items() for x in cells(n)], f"{client} {kind}, data_size long, {LONG}")


def net_of(long: DataFrame) -> Net:
    """The net of one (layer, row, col, value) table."""
    cells = long.select("layer", "row", "col", "value").toPandas()
    if cells.empty:
        raise ValueError("no weights")
    out = []
    for _, t in cells.groupby("layer", sort=True):
        m = t.pivot(index="row", columns="col", values="value")
        if m.isna().any().any() or list(m.index) != list(range(len(m))) or list(m.columns) != list(range(m.shape[1])):
            raise ValueError("a tensor has missing cells")
        out.append(m.to_numpy())
    return Net(tuple(out))


def average_tensors(long: DataFrame, by: Sequence[str] = (), weighted: bool = False, client: str = "client_id") -> DataFrame:
    """Mean of every cell over the clients, (by..., layer, row, col, value),
    optionally weighted by data_size: one grouped aggregate whatever the number
    and shape of the tensors. Clients whose tensors differ in shape are an error
    of the job. No rows: no cells."""
    keys = [*by, "layer", "row", "col"]
    value = F.sum(F.col("value") * F.col("data_size")) / F.sum("data_size") if weighted else F.avg("value")
    cells = long.groupBy(*keys).agg(value.alias("value"), F.count(F.lit(1)).alias("_n"))
    clients = long.groupBy(*by).agg(F.count_distinct(client).alias("_clients"))
    joined = cells.join(clients, list(by)) if by else cells.withColumn("_clients", clients.select("_clients").scalar())
    same = F.when(F.col("_n") == F.col("_clients"), F.col("value")).otherwise(F.raise_error(F.lit("tensors of the clients differ in shape")).cast("double"))
    return joined.select(*keys, same.alias("value"))


def input_importance(long: DataFrame, n_inputs: int, by: Sequence[str] = ()) -> DataFrame:
    """F8: mean of |w| of each input row of the first layer."""
    return (long.where((F.col("layer") == 0) & (F.col("row") < n_inputs)).groupBy(*by, "row")
            .agg(F.avg(F.abs("value")).alias("importance")))


__all__ = ["Fit", "Local", "Net", "average_tensors", "fit", "initial", "input_importance", "local_blocks", "local_train", "long_table", "net_of",
           "prepared", "score_batch", "score_local"]
