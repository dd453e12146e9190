"""Filter audit against a direct count, over many small shards and odd rows."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedsight.llm import interactions


def fails(i, text, rows):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = "A" if len(w) < 100 else ""
    out += "B" if 100 * len(set(w)) < 80 * len(w) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else ""
    out += "D" if re.search(r"[#$%&*|]", t) else ""
    return out + ("E" if i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == t for r in rows) else "")


def brute(rows, good, toxic):
    out = {}
    flagged = [(r[2] or "", fails(r[0], r[1], rows), r[0] in good, r[0] in toxic) for r in rows]
    for part in {f[0] for f in flagged}:
        own, shapley = [f for f in flagged if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                out[part, order, step] = (len(left) - len(gone), len(gone), sum(x in f[1] for f in own) - len(gone),
                                          sum(f[1] == x for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone))
                shapley[x] += len(gone)
                left = [f for f in left if x not in f[1]]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                out[part, order, step] += (shapley[x],)
    return out


LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (3, LONG, "de"), (0, None, "en"), (4, "", None), (5, " \t\n", "fr"), (6, "A B C #", "en"),
        (7, "the end " * 80, "en"), (8, LONG + " |", None), (None, LONG, "en"), (None, None, None), (9, LONG.upper(), "en"), (10, "é" * 9 + "A", "de"),
        (11, "é" * 8 + "A", "de"), (12, "word " * 10_000, "en"), (13, "a b " * 99, "xx"), (14, "", ""), (2, LONG, "en"), (15, "The end " * 80, "en")]


def test_audit_equals_a_direct_count(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (7, 1, 1), (9, None, None), (None, 1, 1), (99, 1, 1), (12, 0, 1)],
                                   "doc_id long, quality long, toxic long").withColumn("part", F.lit("clash"))
    docs = docs_of(ROWS, "part", "n", "good", "fails", "shard", "code").repartition(3)
    got = interactions.audit(interactions.failing(docs, labels))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == brute(ROWS, {1, 2, 7}, {2, 7, 12})


def test_no_documents_or_labels(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert interactions.audit(interactions.failing(docs_of(ROWS).where("false"), labels)).count() == 0
    got = interactions.audit(interactions.failing(docs_of(ROWS), labels))
    assert got.where("good_lost + toxic_lost > 0").count() == 0 and got.count() == 600 * 5


@pytest.mark.parametrize("bits,at_once", [(63, 500_000), (63, 1), (7, 100)])
def test_matrix_rows_and_dictionary(docs_of, bits, at_once):
    """Seven bits make nearly all words clash: they get numbers of their own."""
    docs = docs_of(ROWS).repartition(3).selectExpr("doc_id", "cast(coalesce(text, '') as binary) as text")
    rows, words = interactions.measures(docs, ["doc_id"], "#|", bits, at_once)
    want, every = Counter(), set()
    for r in ROWS:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        every |= set(w)
        want[r[0], len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#|]", t))] += 1
    assert Counter(map(tuple, rows.collect())) == want
    terms = {bytes(r.word).decode(): r.term for r in words.collect()}
    assert set(terms) == every and len(set(terms.values())) == len(every) and (bits == 63 or min(terms.values()) < 0)


def test_matrix_merges_equal_terms():
    pointer, terms, counts = interactions.csr(np.array([0, 0, 0, 2, 2]), np.array([0, 1, 1, 2, 0]), np.array([9, 5, 9]), 4)
    assert pointer.tolist() == [0, 2, 2, 3, 3] and terms.tolist() == [5, 9, 9] and counts.tolist() == [2, 1, 2]
