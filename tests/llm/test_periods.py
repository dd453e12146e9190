"""Periodic runs against a brute-force search, edge texts and digests."""

import hashlib
import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from fedsight.llm import periods, queries


def brute(w):
    """Every lag, every stretch, every smaller period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(6, 4 * q):
                s = w[a:a + length]
                if not any(all(s[x] == s[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.append((a, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    n, k, w = rng.randint(0, 130), rng.choice([1, 2, 2, 3, 5, 30]), []
    while len(w) < n:
        if rng.random() < .3:
            w += ([rng.randrange(k) for _ in range(rng.randint(1, 12))] * rng.randint(1, 9))[:rng.randint(1, 100)]
        else:
            w.append(rng.randrange(k))
    return w


def test_runs_equal_brute_force():
    rng, total = random.Random(7), 0
    for _ in range(1500):
        w = made(rng)
        want = brute(w)
        assert periods.find_runs(np.array(w, dtype=np.int64)) == want, w
        total += len(want)
    assert total > 1000


def test_long_texts_stay_linear():
    began = time.time()
    assert periods.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    assert periods.find_runs(np.arange(300_000) % 75_000) == [(0, 300_000, 75_000)]
    assert periods.find_runs(np.arange(300_000) % 75_001) == []
    a, b = [0], [0, 1]
    while len(b) < 200_000:
        a, b = b, b + a
    assert periods.find_runs(np.array(b)) == []                    # no word of Fibonacci's has an exponent of 4
    assert time.time() - began < 20


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(((-length, s, q) for s, length, q in runs), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_query_on_odd_documents(spark, docs_of, tmp_path):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (5, "a " * 5), (None, "x y " * 4), (None, None), (6, "x y " * 4), (6, "x y " * 4),
            (7, "é ü é ü\n" * 9), (8, " " * 7), (9, " ".join(f"w{i % 40}" for i in range(400)))]
    rows += [(100 + i, " ".join(f"t{x}" for x in made(rng))) for i in range(60)]
    docs_of(rows, "runs", "key", "collapsed", "start").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted((expected(*r) for r in rows), key=order)
    assert {zlib.crc32(str(r[0]).encode()) % 10 for r in rows} >= {0, 1}


def test_no_documents_and_extra_columns(docs_of):
    df = docs_of([(1, "a b a b a b a b c")], "doc", "runs", "text2").withColumnsRenamed({"doc_id": "k", "text": "body"})
    row = periods.detect(df, "k", "body").first()
    assert (row.doc_id, [tuple(r) for r in row.runs], row.collapsed) == (1, [(0, 8, 2)], "a b c")
    assert periods.detect(df.where(F.lit(False)), "k", "body").count() == 0
