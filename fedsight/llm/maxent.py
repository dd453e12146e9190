"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). The most
frequent words stand in classes of neighbouring frequency; all other words, the
unseen ones included, stand in classes by their last two bytes, inside which
counts decide (absolute discounting; what it takes off goes to the class's
unseen words). Both softmax steps start from the unigram counts and add weights
of the context's features: the word before, the two words before, and the word
before the previous one (a skip). Features are hashed to the rows of two tables
of fixed size, one over classes and one over the words of a class.

Counts cover all training texts (see :mod:`shards`). The weights are trained on
all training texts, too: these are dealt into rounds; in each round every task
makes AdaGrad steps on its own texts from the round's common weights, and the
changes are averaged row by row, weighted by the squared gradients behind them,
in a tree of sums. What the driver holds is the two tables and the head words.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.functions.tensors import tree_sum
from fedsight.llm import shards
from fedsight.llm.common import by_value, ensure_checkpoint_dir

by_value(__name__)

#: Words of a class, classes of frequent words, classes of the others, and buckets that the others are seen as in a context.
CLASS_WORDS, HEAD_CLASSES, TAIL_CLASSES, TAIL_BUCKETS = 64, 20, 12, 1020
#: Rows of each weight table, and rows that are summed together.
TABLE_ROWS, BLOCK_ROWS = 1 << 14, 1 << 10
ROUNDS, STEP, MINIBATCH = 4, 0.3, 4096
BEGIN = 1 << 20
#: Odd multipliers of the feature hashes.
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


@dataclass
class Model:
    """``prior``: log probabilities of classes; ``inner``: of a head class's
    words (one row a class); ``u`` and ``w``: hashed weights over classes and
    over a class's words, with their AdaGrad sums; ``n_head``: head words."""
    n_head: int
    prior: np.ndarray
    inner: np.ndarray
    u: np.ndarray
    w: np.ndarray
    u_sum: np.ndarray
    w_sum: np.ndarray

    def copy(self) -> "Model":
        return Model(self.n_head, self.prior, self.inner, self.u.copy(), self.w.copy(), self.u_sum.copy(), self.w_sum.copy())

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.n_head, ids // CLASS_WORDS, len(self.inner) + (ids - self.n_head) % TAIL_CLASSES)

    def log_probs(self, ids: np.ndarray, features: list[np.ndarray], step: float = 0.0) -> np.ndarray:
        """Natural log probability of each token (a tail word's is that of its
        class); with a ``step`` the weights are moved up the gradient."""
        cls, at = self.class_of(ids), np.arange(len(ids))
        rows = [hashed(f, len(self.u)) for f in features]
        z = np.take(self.u, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(self.u, r, axis=0)
        z += self.prior
        p, total = _softmax(z, step > 0)
        out = z[at, cls].astype(float) - total
        if step:
            p[at, cls] -= 1
            for r in rows:
                _descend(self.u, self.u_sum, r, p, step)
        head = np.flatnonzero(ids < self.n_head)
        if len(head):
            own, word = cls[head], ids[head] % CLASS_WORDS
            salt = (own.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[1])
            rows = [hashed(features[i][head] + salt, len(self.w)) for i in (0, 2)]
            z = np.take(self.w, rows[0], axis=0)
            z += np.take(self.w, rows[1], axis=0)
            z += self.inner[own]
            p, total = _softmax(z, step > 0)
            at = np.arange(len(head))
            out[head] += z[at, word] - total
            if step:
                p[at, word] -= 1
                for r in rows:
                    _descend(self.w, self.w_sum, r, p, step)
        return out


def _softmax(z: np.ndarray, shares: bool) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (if asked for) and log normalisers; ``z`` is held within +-60 in place."""
    np.clip(z, -60, 60, out=z)
    e = np.exp(z)
    total = np.einsum("ij->i", e)
    if shares:
        e /= total[:, None]
    return e, np.log(total.astype(np.float64))


def _descend(table: np.ndarray, sums: np.ndarray, rows: np.ndarray, gradient: np.ndarray, step: float) -> None:
    """One AdaGrad step of the table's rows, with one sum of squares a row."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    own, g = rows[starts], np.add.reduceat(np.take(gradient, order, axis=0), starts, axis=0)
    sums[own] += np.einsum("ij,ij->i", g, g) / g.shape[1]
    g *= (step / np.sqrt(sums[own] + 1e-8))[:, None]
    table[own] -= g


def hashed(features: np.ndarray, n_rows: int) -> np.ndarray:
    x = features * np.uint64(MIX[0])
    return ((x >> np.uint64(40)) % np.uint64(n_rows)).astype(np.uint16 if n_rows <= 1 << 16 else np.int64)


def neighbours(ids: np.ndarray, pointer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the one before that of each token; a text begins after begin marks."""
    first = np.full(len(ids) + 2, BEGIN, dtype=np.int32)
    first[2:] = ids
    p1, p2 = first[1:-1].copy(), first[:-2].copy()
    starts = pointer[:-1][np.diff(pointer) > 0]
    p1[starts], p2[starts] = BEGIN, BEGIN
    second = starts + 1
    p2[second[second < len(ids)]] = BEGIN
    return p1, p2


def features_of(p1: np.ndarray, p2: np.ndarray) -> list[np.ndarray]:
    """Feature values of contexts: the word before, the two before, and the one before the previous."""
    p1, p2 = p1.astype(np.uint64), p2.astype(np.uint64)
    out = [p1 * np.uint64(MIX[1]) + np.uint64(1), (p1 * np.uint64(MIX[2]) + p2) * np.uint64(MIX[1]) + np.uint64(2), p2 * np.uint64(MIX[2]) + np.uint64(3)]
    return [x ^ (x >> np.uint64(29)) for x in out]


def log_probs(model: Model, ids: np.ndarray, pointer: np.ndarray, step: float = 0.0) -> np.ndarray:
    """Natural log probability of each token of the texts that ``pointer`` cuts ``ids`` into."""
    p1, p2 = neighbours(ids, pointer)
    out = np.zeros(len(ids))
    for a in range(0, len(ids), MINIBATCH):
        b = a + MINIBATCH
        out[a:b] = model.log_probs(ids[a:b].astype(np.int64), features_of(p1[a:b], p2[a:b]), step)
    return out


def _numbered(docs: DataFrame, keep: list[str], train: Column, rounds: int, round_of: Column, words_per_shard: int) -> tuple[DataFrame, Model, int]:
    """Staged texts as word numbers with the scores that counts alone decide,
    the model before training, and the number of training tokens."""
    rows = docs.withColumns({"__train": train, "__round": F.when(train, F.pmod(round_of, F.lit(rounds))).otherwise(F.lit(-1)).cast("int")})
    encoded = shards.encode(rows, "text", [*keep, "__round"], F.col("__train"), lower=True, end=True, words_per_shard=words_per_shard)
    terms = shards.dictionary(encoded)
    seen = terms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("n") > 0).cast("int")), F.lit(0)).alias("v")).first()
    n_tokens, n_words = int(seen["n"]), int(seen["v"])
    # At most CLASS_WORDS * HEAD_CLASSES words.
    top = terms.where("n > 0").orderBy(F.desc("n"), "word").limit(CLASS_WORDS * HEAD_CLASSES).collect()
    n_head, n_inner = len(top), -(-len(top) // CLASS_WORDS)
    ranks = docs.sparkSession.createDataFrame([(r["word"], i) for i, r in enumerate(top)], "word binary, rank int")
    bucket = F.crc32(F.expr("substring(word, -2)")) % TAIL_BUCKETS
    placed = terms.join(F.broadcast(ranks), "word", "left").select(
        "word", "n", F.coalesce("rank", (n_head + bucket).cast("int")).alias("g"))
    tail = placed.where(F.col("g") >= n_head).groupBy(((F.col("g") - n_head) % TAIL_CLASSES).alias("k")).agg(
        F.sum("n").alias("n"), *(F.sum(F.expr(f"cast({c} as int)")).alias(a) for a, c in (("v", "n > 0"), ("one", "n = 1"), ("two", "n = 2")))).collect()
    tail_n, tail_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in tail:
        tail_n[r["k"]], tail_v[r["k"]] = r["n"], r["v"]
    one, two = sum(r["one"] for r in tail), sum(r["two"] for r in tail)
    discount = float(np.clip(one / (one + 2 * two) if one else 0.5, 0.1, 0.9))
    head_n = np.zeros(n_inner * CLASS_WORDS)
    head_n[:n_head] = [r["n"] for r in top]
    head_n = head_n.reshape(n_inner, CLASS_WORDS)
    class_n = np.concatenate((head_n.sum(axis=1), tail_n))
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.log(head_n) - np.log(head_n.sum(axis=1, keepdims=True)) if n_inner else head_n
        unseen = np.where(tail_n > 0, np.log10(discount * tail_v) - np.log10(tail_n), 0.0)      # an empty class has unseen words only
        tail_log = np.log10(tail_n)
    tables = [np.zeros((TABLE_ROWS, k), dtype=np.float32) for k in (len(class_n), CLASS_WORDS)]
    model = Model(n_head, np.log((class_n + 0.5) / (n_tokens + 0.5 * len(class_n))).astype(np.float32), inner.astype(np.float32), *tables,
                  *(np.zeros(TABLE_ROWS, dtype=np.float32) for _ in tables))
    base_total = np.log10(n_tokens + 0.5 * (n_words + 1))

    def number(table: pa.Table, columns: pa.Table) -> pa.Table:
        pointer, codes = shards.unpacked(table.column("codes"))
        n, g = columns.column("n").to_numpy(), columns.column("g").to_numpy()
        of_word = np.zeros(len(g))
        rest = g >= n_head
        k, c = (g[rest] - n_head) % TAIL_CLASSES, n[rest]
        of_word[rest] = np.where(c > 0, np.log10(np.maximum(c, 1) - discount) - np.where(c > 0, tail_log[k], 0), unseen[k])
        at = pointer[:-1]
        facts = {"n_tokens": pa.array(np.diff(pointer)), "n_known": pa.array(np.add.reduceat((n > 0)[codes].astype(np.int64), at)),
                 "base_score": pa.array(np.add.reduceat((np.log10(n + 0.5) - base_total)[codes], at)),
                 "tail_score": pa.array(np.add.reduceat(of_word[codes], at)),
                 "ids": pa.array([shards.packed(x, "<u2") for x in np.split(g.astype("<u2")[codes], pointer[1:-1])], pa.binary())}
        out = table.select([*keep, "__round"])
        for name, x in facts.items():
            out = out.append_column(name, x)
        return out

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "__round int", "n_tokens bigint", "n_known bigint",
                        "base_score double", "tail_score double", "ids binary"])
    numbered = shards.translate(encoded, placed, number, schema)
    path = os.path.join(ensure_checkpoint_dir(docs.sparkSession), f"numbered-{uuid.uuid4().hex}")
    numbered.write.partitionBy("__round").parquet(path)             # a round reads its own texts only
    return docs.sparkSession.read.schema(numbered.schema).parquet(path), model, n_tokens


def _trained(texts: DataFrame, model: Model, step: float) -> Model:
    """The model after one round over ``texts``."""
    ids = texts.select("ids")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = model.copy(), TaskContext.get().partitionId()
        for batch in batches:
            pointer, flat = shards.unpacked(batch.column("ids"), "<u2")
            log_probs(own, flat, pointer, step)
        for name, new, old, new_sum, old_sum in (("u", own.u, model.u, own.u_sum, model.u_sum), ("w", own.w, model.w, own.w_sum, model.w_sum)):
            for b in range(0, len(new), BLOCK_ROWS):
                gain = new_sum[b:b + BLOCK_ROWS] - old_sum[b:b + BLOCK_ROWS]
                if gain.any():
                    moved = (new[b:b + BLOCK_ROWS] - old[b:b + BLOCK_ROWS]) * gain[:, None]
                    value = np.concatenate((gain, gain * gain, moved.ravel())).astype("<f4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b], pa.int32()), pa.array([part], pa.int64()), pa.array([value], pa.binary())],
                                                     ["name", "block", "part", "value"])

    parts = ids.mapInArrow(learn, "name string, block int, part bigint, value binary")
    out = model.copy()
    for r in tree_sum(parts, ["name", "block"], ids.rdd.getNumPartitions(), dtype="<f4").collect():      # the two tables at most
        table, sums = (out.u, out.u_sum) if r["name"] == "u" else (out.w, out.w_sum)
        x, b = np.frombuffer(bytes(r["value"]), dtype="<f4"), slice(r["block"], r["block"] + BLOCK_ROWS)
        gain, squares, moved = x[:BLOCK_ROWS], x[BLOCK_ROWS:2 * BLOCK_ROWS], x[2 * BLOCK_ROWS:].reshape(BLOCK_ROWS, -1)
        some = np.maximum(gain, 1e-30)
        table[b] += moved / some[:, None]
        sums[b] += squares / some
    return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, step: float = STEP,
          words_per_shard: int = shards.WORDS_PER_SHARD) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every row, by a model of the rows for which ``train`` is true (null: false).

    Tokens are runs of anything but ASCII white space, A-Z in lower case, and
    one end token; a null text is empty and has the end token only. n_known
    tokens occur in training texts; train_tokens is their number N.
    ``base_score`` is the unigram log10 probability with 0.5 added to the counts
    of the V known words and of one unknown word; ``score`` is the model's log10
    probability. Repeated rows and ids are scored (and learned) each; a null id
    is like any other. Without training rows every class is equally likely.
    Other columns are not read.
    """
    train = F.coalesce(train, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), (~train).alias("held_out"))
    deal = F.shiftrightunsigned(F.xxhash64("doc_id"), 8)
    numbered, model, n_tokens = _numbered(rows, ["doc_id", "held_out"], ~F.col("held_out"), rounds, deal, words_per_shard)
    for r in range(rounds):
        model = _trained(numbered.where(F.col("__round") == r), model, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pointer, flat = shards.unpacked(batch.column("ids"), "<u2")
            total = np.concatenate(([0.0], np.cumsum(log_probs(model, flat, pointer))))
            own = (total[pointer[1:]] - total[pointer[:-1]]) / np.log(10) + batch.column("tail_score").to_numpy()
            cols = [*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(own), n_tokens)), batch.column("base_score"), pa.array(own)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return numbered.drop("__round").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, "
                                               "train_tokens bigint, base_score double, score double")
