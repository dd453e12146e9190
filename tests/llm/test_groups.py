"""SimHash groups, components and shards against brute force."""

import random
import zlib

import numpy as np
import xxhash

from fedsight.llm import components, sharding, simhash

M = (1 << 64) - 1


def brute_fp(text, k=3):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate(
        str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})).split(" ") if x]
    if not w:
        return 0
    g = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(fps, d=3):
    at = {f: f for f in fps}

    def root(f):
        while at[f] != f:
            f = at[f]
        return f
    fs = sorted(set(fps))
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= d:
                at[root(a)] = root(b)
    return {f: root(f) for f in fs}


def test_fingerprint_matches_spark_hash_and_brute_force(spark, docs_of):
    texts = ["", None, " \n", "One", "one  TWO", "one two three", "Ärger über ÖL ÄÖ", "a b c d a b c d a b c", "x " * 70_000, "nbsp\xa0is a word", "\x1fa b\x1c c"]
    for t in texts:
        assert simhash.simhash(t) & M == brute_fp(t)
    row = spark.sql("select xxhash64('one two three') as h").first()
    assert simhash.simhash("one two three") == row.h


def test_links_match_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, M]
    fps = set(base)
    for f in base:
        for _ in range(6):
            g = f
            for _ in range(rng.randint(1, 5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed + signed[:5]] + [(None,)], "fp long")
    for d, segments in ((3, 2), (3, 4), (2, 2), (0, 2), (1, 4)):
        got = {frozenset((r.a & M, r.b & M)) for r in simhash.hamming_links(df, "fp", d, segments).collect()}
        fs = sorted(fps)
        assert got == {frozenset((a, b)) for i, a in enumerate(fs) for b in fs[:i] if bin(a ^ b).count("1") <= d}


def test_near_duplicates_whole(docs_of):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(30):
        w = rng.choices(vocabulary, k=300)
        for j in range(4):
            c = list(w)
            for _ in range(j):
                c[rng.randrange(len(c))] = "edit"
            rows.append((rng.randrange(10**6), " ".join(c)))
    rows += [(7, None), (9, ""), (7, " "), (None, ""), (None, "alone in the world"), (50, "same text"), (50, "same text"), (3, "SAME text")]
    rows += [(200 + i, "copy of one text that is long enough") for i in range(300)]
    got = simhash.near_duplicates(docs_of(rows, "fp", "component_id", "root", "node")).collect()
    assert len(got) == len(rows)
    group = brute_groups([brute_fp(t) for _, t in rows])
    least = {}
    for i, t in rows:
        g = group[brute_fp(t)]
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(((i, brute_fp(t), least.get(group[brute_fp(t)])) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.fp & M, r.component_id) for r in got), key=repr) == want
    df = docs_of(rows, "fp", "component_id")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 2
    assert simhash.near_duplicates(docs_of([])).count() == 0 and simhash.deduplicate(docs_of([])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (None, 3), (4, None)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(180)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    at = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            at.setdefault(a, a), at.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in at and b in at and at[a] != at[b]:
                at[a] = at[b] = min(at[a], at[b])
                changed = True
    assert got == at
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def greedy(sizes, n, cap):
    used, left = 1, cap
    for s in sizes:
        if s > cap:
            return False
        if s > left:
            used, left = used + 1, cap
        left -= s
    return used <= n


def check_shards(rows, got, n):
    assert len(got) == len(rows)
    by_shard, of_text = {}, {}
    texts = {}
    for i, t in rows:
        texts.setdefault((i, zlib.crc32((t or "").encode())), []).append(t or "")
    for r in got:
        t = texts[r.doc_id, r.text_crc32][0]
        assert r["size"] == len(t.encode()) + 1
        by_shard.setdefault(r.shard, []).append(r)
        assert of_text.setdefault(t, r.shard) == r.shard
    for s, rs in by_shard.items():
        assert 0 <= s < n and sorted(r.slot for r in rs) == list(range(len(rs)))
    import hashlib
    sizes = {}
    for _, t in rows:
        b = (t or "").encode()
        k = hashlib.sha256(b).digest()
        sizes[k] = sizes.get(k, 0) + len(b) + 1
    order = [sizes[k] for k in sorted(sizes)]
    best = next(c for c in range(max(order), sum(order) + 1) if greedy(order, n, c))
    assert max(sum(r["size"] for r in rs) for rs in by_shard.values()) == best


def test_shards_have_the_smallest_largest_size(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "PROBES", 5)
    rng = random.Random(4)
    rows = [(i, "é" * rng.randint(0, 40)) for i in range(300)] + [(i, "hot") for i in range(1000, 1200)] + [
        (1, None), (None, "x"), (None, "x"), (5, "dup"), (5, "dup"), (6, "long " * 300)]
    for n in (16, 3, 1):
        check_shards(rows, sharding.shard(docs_of(rows, "size", "shard", "slot", "key", "salt"), n).collect(), n)
    few = [(1, "a"), (2, "bb")]
    check_shards(few, sharding.shard(docs_of(few), 16).collect(), 16)
    assert sharding.shard(docs_of([]), 16).count() == 0
    assert np.unique([r.shard for r in sharding.shard(docs_of([(i, "one") for i in range(50)]), 4).collect()]).size == 1
