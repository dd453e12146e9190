"""Language-model scoring: counts by hand, probabilities that sum to one, gradients, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedsight.llm import maxent, queries, shards


def tokens(text):
    t = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", t.lower()) + [b""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def languages(n):
    """Texts in two made-up languages: neighbours tell which."""
    rng = np.random.default_rng(5)
    names = [[f"{p}{i}{e}" for i in range(60)] for p, e in (("a", "en"), ("b", "os"))]
    return [(i, " ".join(rng.choice(names[i % 2], 80, p=np.arange(60, 0, -1) / 1830)) + (f" Only{i}" if i % 3 else "")) for i in range(n)]


def test_counts_base_score_and_gain(spark, docs_of, tmp_path):
    rows = languages(120) + [(200, None), (201, ""), (202, " \t\n"), (None, "A0en a0EN ÄÖ"), (None, None), (203, "É é x" * 40), (204, "a0en " * 30_000), (5, "dup id"), (5, "dup id")]
    docs_of(rows, "ids", "train", "n", "g", "shard", "held_out").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_lm_scoring(spark, str(tmp_path)).collect()
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + .5) / (n + .5 * (v + 1))) for x in w), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    away = [r for r in got if r.held_out and (r.doc_id or 0) < 120]
    assert len(away) > 10 and sum(r.score > r.base_score for r in away) > 0.9 * len(away)


def test_no_training_rows_and_no_rows(docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    got = {r.doc_id: r for r in maxent.score(docs, F.lit(None).cast("boolean")).collect()}
    assert got[1].train_tokens == 0 and got[1].base_score == 0 and got[1].n_known == 0
    assert got[1].score == pytest.approx(3 * math.log10(1 / maxent.TAIL_CLASSES), rel=1e-5)
    assert maxent.score(docs.where("false"), F.lit(True)).count() == 0


def contexts(ids, pointer):
    return maxent.features_of(*maxent.neighbours(ids, pointer))


def some_model(seed=1, n_head=200):
    rng, n_inner = np.random.default_rng(seed), -(-n_head // maxent.CLASS_WORDS)
    counts = np.zeros(n_inner * maxent.CLASS_WORDS)
    counts[:n_head] = np.arange(n_head, 0, -1)
    counts = counts.reshape(n_inner, -1)
    with np.errstate(divide="ignore"):
        inner = np.log(counts / counts.sum(axis=1, keepdims=True))
    prior = np.log(rng.dirichlet(np.ones(n_inner + maxent.TAIL_CLASSES)))
    u, w = (rng.normal(0, .5, (maxent.TABLE_ROWS, k)).astype(np.float32) for k in (len(prior), maxent.CLASS_WORDS))
    return maxent.Model(n_head, prior.astype(np.float32), inner.astype(np.float32), u, w, np.zeros(len(u), np.float32), np.zeros(len(w), np.float32))


def test_probabilities_sum_to_one():
    m = some_model()
    every = np.array([*range(m.n_head), *(m.n_head + k for k in range(maxent.TAIL_CLASSES))])
    for before in ([], [3], [3, 17], [250, 3]):
        features = contexts(np.array([*before, 0]), np.array([0, len(before) + 1]))
        one = [np.repeat(f[-1:], len(every)) for f in features]
        assert np.exp(m.log_probs(every, one)).sum() == pytest.approx(1, abs=1e-4)


def test_context_does_not_cross_texts():
    both = contexts(np.array([5, 6, 7, 8, 9]), np.array([0, 1, 1, 5]))
    alone = contexts(np.array([6, 7, 8, 9]), np.array([0, 4]))
    assert [f[1:].tolist() for f in both] == [f.tolist() for f in alone]


def test_steps_follow_the_gradient():
    m, ids = some_model(2), np.array([3, 199, 3, 230, 64, 3])
    features = contexts(ids, np.array([0, 6]))
    for table, rows_of in (("u", lambda f: [f[0]]), ("w", lambda f: [f[0][:1] + np.uint64(maxent.MIX[1])])):
        new = m.copy()
        new.log_probs(ids, features, step=1.0)
        row = int(maxent.hashed(rows_of(features)[0][:1], maxent.TABLE_ROWS)[0])
        moved = getattr(new, table)[row] - getattr(m, table)[row]
        col = int(np.argmax(np.abs(moved)))
        up = m.copy()
        getattr(up, table)[row, col] += 0.02
        down = m.copy()
        getattr(down, table)[row, col] -= 0.02
        slope = (up.log_probs(ids, features).sum() - down.log_probs(ids, features).sum()) / 0.04
        size = np.sqrt(getattr(new, table + "_sum")[row] + 1e-8)
        assert moved[col] * size == pytest.approx(slope, rel=0.05, abs=2e-3)


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_packed_numbers_return(kind):
    import pyarrow as pa
    rows = [[], [0, 1, 65535], [7], []]
    pointer, flat = shards.unpacked(pa.array([shards.packed(np.array(r), kind) for r in rows], pa.binary()), kind)
    assert pointer.tolist() == [0, 0, 3, 4, 4] and flat.tolist() == [0, 1, 65535, 7]
