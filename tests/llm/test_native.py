"""Operators that are built-in expressions only, against brute force and on edge rows."""

import math
import re

import pytest

from fedsight.llm import decontaminate, licenses, quality, urls

words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())


def bigrams(t):
    w = words(t)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


LICENSE_DOCS = [
    (1, "intro text here\nReleased under the MIT License.\nmore of the same"), (2, "RELEASED under  the (MIT) licence!"), (3, None), (4, ""),
    (5, "released under the mit license"), (5, "released under the mit license"), (None, "Licensed under CC BY-NC 4.0."),
    (6, "word " * 30_000), (7, licenses.TEMPLATES["MIT"]), (8, licenses.TEMPLATES["MIT"].replace(", ", ",\n")), (9, "\n\n\n"), (10, "a"),
]


def test_licenses_match_brute_force(docs_of):
    got = {(r.doc_id, r.license): (round(r.dice, 6), r.n_units) for r in
           licenses.scan(docs_of(LICENSE_DOCS, "w", "unit", "license", "dice", "gram")).collect()}
    want = {}
    for i, t in set(LICENSE_DOCS):
        t = t or ""
        for u in {*t.split("\n"), *re.split(r"\n[ \t\r]*\n", t), t}:
            a = bigrams(u)
            for name, text in licenses.TEMPLATES.items():
                b = bigrams(text)
                d = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if d >= 0.8:
                    old = want.get((i, name), (0, 0))
                    want[i, name] = max(old[0], round(d, 6)), old[1] + 1
    assert got == want
    assert (1, "MIT notice") in got and (None, "CC-BY-NC-4.0 notice") in got and (7, "MIT") in got and (8, "MIT") in got


def test_licenses_inside_long_documents(docs_of):
    """Licences of several paragraphs, or wrapped, and notices in longer lines."""
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0 header"]
    mit = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    gpl = gpl.replace("version. This", "version.\n\nThis")
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    around = "\n".join(f"line {i} of a long text about other things number {i}" for i in range(300))
    rows = [(1, f"{around}\n\n{mit}\n\n{around}"), (2, f"{around}\n\n{gpl}\n\n{around}"), (3, f"{around}\n{wrapped}\n{around}"), (4, around),
            (5, "This file is released under the MIT License and maintained by the project team."), (6, "Released under the")]
    got = {(r.doc_id, r.license): (r.dice, r.n_units) for r in licenses.scan(docs_of(rows)).collect()}
    assert got == {(1, "MIT"): (1.0, 1), (2, "GPL-3.0 header"): (1.0, 1), (3, "MIT"): (1.0, 1), (5, "MIT notice"): (1.0, 1)}


def brute_window(text, template, t):
    """Largest coefficient of any window: all that are as long as the template or longer, and all between edges."""
    b, total = bigrams(template), len(words(template)) - 1
    need, most = math.ceil(len(b) * t / (2 - t) - 1e-9), math.floor(total * (2 - t) / t + 1e-9)
    parts = [words(x) for x in re.split(r"\n|(?<=[.!?;:])\s+", text)]
    w, edges = sum(parts, []), {sum(map(len, parts[:i])) for i in range(len(parts) + 1)}
    g, best = [f"{x} {y}" for x, y in zip(w, w[1:])], 0
    for s in range(len(g)):
        seen, hit = set(), set()
        for e in range(s, min(s + most, len(g))):
            seen.add(g[e])
            hit |= b & {g[e]}
            if e - s + 1 >= total or e - s + 1 >= need and s in edges and e + 2 in edges:
                best = max(best, 2 * len(hit) / (len(seen) + len(b)))
    return best


def test_license_windows_match_brute_force(docs_of):
    import random
    rng, names = random.Random(5), ("MIT notice", "CC0-1.0 notice", "GPL-3.0 header")
    templates = {n: licenses.TEMPLATES[n] for n in names}
    rows = []
    for i in range(24):
        out = []
        for k in range(rng.randint(1, 4)):
            w = templates[rng.choice(names)].split()
            for _ in range(rng.randint(0, len(w) // 6)):
                w[rng.randrange(len(w))] = rng.choice(["", f"x{i}y{k}", "the", "\n"])
            cut = rng.random() < 0.3 and rng.randint(1, len(w) // 4)
            out += [f"a{i}b{k}c{j}" + rng.choice(["", ".", "\n"]) for j in range(rng.randint(0, 30))] + w[cut or 0:]
        rows.append((i, rng.choice([" ", "  "]).join(out)))
    got = {(r.doc_id, r.license): round(r.dice, 6) for r in licenses.scan(docs_of(rows), templates).collect()}
    want = {}
    for i, x in rows:
        units = {*x.split("\n"), *re.split(r"\n[ \t\r]*\n", x), x}
        for n in names:
            b = bigrams(templates[n])
            d = max([brute_window(x, templates[n], 0.8), *(2 * len(b & bigrams(u)) / (len(b) + len(bigrams(u))) for u in units)])
            if d >= 0.8:
                want[i, n] = round(d, 6)
    assert got == want and len(want) > 20


def test_licenses_notice_file(docs_of):
    """Very many licences in one text take time in proportion to it."""
    import time
    file = "\n\n".join(f"Copyright {1900 + i} holder{i}\n\n{licenses.TEMPLATES['MIT']}" for i in range(100))
    started = time.time()
    got = licenses.scan(docs_of([(1, file)])).collect()
    assert [(r.license, r.dice) for r in got] == [("MIT", 1.0)] and time.time() - started < 60


def test_licenses_empty(docs_of):
    assert licenses.scan(docs_of([])).count() == 0
    assert licenses.scan(docs_of(LICENSE_DOCS), {"own": "one"}).count() == 0
    assert licenses.scan(docs_of([(1, "some words of mine")]), {"own": "Some words, of mine"}).collect()[0].dice == 1


ITEM = " ".join(f"w{i}" for i in range(40))


def brute_contained(docs, items, k, t):
    def grams(x):
        w = words(x)
        return {" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    out = {}
    by_item = {}
    for i, x in items:
        if i is not None:
            by_item.setdefault(i, set()).update(grams(x))
    for d, x in docs:
        for i, g in by_item.items():
            if d is not None and g and len(g & grams(x)) >= math.ceil(t * len(g) - 1e-9):
                out[d, i] = max(out.get((d, i), 0), len(g & grams(x)))
    return out


def test_decontamination_matches_brute_force(spark, docs_of):
    import random
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(0, ITEM), (1, "short one"), (2, "Tie tie tie tie tie tie tie"), (3, None), (4, ""), (5, ITEM), (None, ITEM),
             *[(10 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(25)]]
    docs = [(1, "x y " + ITEM.upper() + " z"), (2, "a short, one"), (3, None), (4, ""), (5, " ".join(ITEM.split()[:34])), (6, " ".join(ITEM.split()[:30])),
            (7, "tie " * 9), (8, ITEM), (8, ITEM), (8, "other words"), (None, ITEM), (9, "n " * 40_000 + ITEM + " n" * 40_000), (11, "Short one")]
    for i, (_, x) in enumerate(items[7:]):
        w = x.split()
        for j in range(3):
            part = list(w)
            for _ in range(j):
                part[rng.randrange(len(part))] = "edit"
            docs.append((100 + 10 * i + j, " ".join(rng.choices(vocabulary, k=50) + part + rng.choices(vocabulary, k=50))))
    table = spark.createDataFrame(items, "item_id long, text string")
    for k, t in ((5, 0.8), (2, 0.5), (5, 1.0)):
        got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contaminated(docs_of(docs, "w", "i", "h", "gram", "q", "x"), table, k, t).collect()}
        assert got == brute_contained(docs, items, k, t)
    kept = [r.doc_id for r in decontaminate.decontaminate(docs_of(docs, "w", "item_id"), table).collect()]
    bad = {d for d, _ in brute_contained(docs, items, 5, 0.8)}
    assert sorted(map(str, kept)) == sorted(str(d) for d, _ in docs if d not in bad)


def test_decontamination_shared_passages(spark, docs_of):
    """A passage that many items share stands for none that has enough shingles of its own."""
    shared = " ".join(f"s{i}" for i in range(14))
    items = [(i, f"{shared} " + " ".join(f"own{i}x{j}" for j in range(30))) for i in range(60)] + [(99, shared)]
    table = spark.createDataFrame(items, "item_id long, text string")
    grams = decontaminate.item_shingles(table, "item_id", "text", 5)
    sketch = decontaminate.item_sketches(grams, 0.8)
    hot = {r.h for r in grams.where("item_id = 99").collect()}
    assert {r.item_id for r in sketch.collect() if r.h in hot} == {99}
    docs = [(1, shared), (2, "a b c " + items[7][1]), (3, items[8][1][:150]), (4, "other words")]
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contaminated(docs_of(docs), table).collect()}
    assert got == brute_contained(docs, items, 5, 0.8) and {(1, 99), (2, 7)} <= got.keys()


def test_decontamination_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.contaminated(docs_of([(1, ITEM)]), none).count() == 0
    assert decontaminate.contaminated(docs_of([]), some).count() == 0
    assert decontaminate.decontaminate(docs_of([(1, ITEM), (2, None)]), none).count() == 2


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_quality_base_and_distances(docs_of):
    prose = "The ship of the line was in port, and it is said that the crew was not on deck at all.\n"
    rows = [(1, prose * 3), (2, None), (3, ""), (4, " \t\n"), (5, "a b c a b c d"), (6, "line one\nline one\n \n \nline one\nlast"),
            (7, "x# $y %%z <|>"), (8, "é ü ß Ωmega 123, (ok)!"), (8, "é ü ß Ωmega 123, (ok)!"), (None, "same same same same"),
            (9, " ".join(f"u{i} the of" for i in range(30_000))), (10, "der die und in den von zu das mit sich " * 8 + prose, "de")]
    df = docs_of(rows, "t", "w", "cc", "g", "near")
    refs = quality.references(df.where("doc_id is null or doc_id <> 9"))    # its 30,000 numbers would be the reference's digits
    assert set(refs) == {"en", "de"}
    got = {}
    for r in quality.judged(df, refs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[8]) == 2
    for row in rows:
        i, t = row[0], row[1] or ""
        r = got[i][0]
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        g = list(zip(w, w[1:], w[2:]))
        seen = {x for x in g if g.count(x) > 1} if len(g) < 1000 else {("u0", "the", "of")} - {("u0", "the", "of")}
        cover = {p + j for p, x in enumerate(g) if x in seen for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)), (i, r)
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        plain = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub(quality.PUNCTUATION, "", t).lower()) if x]
        if plain:
            p = [plain.count(x) / len(plain) for x in quality.WORDS]
            p.append(1 - sum(p))
            assert r.word_distance == pytest.approx(js(p, refs[r.nearest][1]), abs=2e-6)
    assert not got[2][0].kept and not got[9][0].base_failed
    # A text unlike its nearest reference goes; judged by other documents' references.
    odd = docs_of([(1, " ".join(f"zz{i}# qq{i}$" for i in range(100))), (2, " ".join(f"zz{i}" for i in range(60)))])
    assert {r.doc_id: r.kept for r in quality.judged(odd, refs).collect()} == {1: False, 2: False}
    assert {r.doc_id: r.kept for r in quality.judged(odd, refs, min_chars=10**6, min_words=10**6).collect()} == {1: True, 2: True}
    # A named language without a reference is not held against others; an unnamed one is.
    polish = " ".join(f"{a}{b}" for a in ("przy", "chod", "wie", "trz", "kon", "brze", "szcz", "gdy", "nie", "roz") for b in ("ek", "anie", "ony", "ach", "ie", "u", "ą", "y", "em", "ami", "ość", "ski", "ne"))
    far = docs_of([(1, polish, "pl"), (2, polish, None), (3, polish, "en")])
    assert {r.doc_id: r.kept for r in quality.judged(far, refs).collect()} == {1: True, 2: False, 3: False}
    assert {r.kept for r in quality.judged(far.drop("lang"), refs).collect()} == {False}


def test_quality_without_reference(docs_of):
    df = docs_of([(1, " ".join(f"w{i}" for i in range(80)), "xx"), (2, "short", None)])
    assert quality.references(df) == {}
    assert {r.doc_id: (r.kept, r.nearest) for r in quality.judged(df, {}).collect()} == {1: (True, None), 2: (False, None)}
    assert quality.judged(docs_of([]), {}).count() == 0 and quality.references(docs_of([])) == {}


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_rules(spark):
    rows = [(1, "http://A.Example.com/en/1"), (2, "https://www.example.com/en/1"), (3, "https://x.www.example.com/en/1?a=/es/"), (4, "http://b.com"),
            (5, "http://b.com/x#y"), (6, "http://c.net/es/"), (7, "http://c.net/ES/"), (8, None), (9, "no scheme/en/"), (10, ""),
            (11, "http://notexample.com/en/"), (12, "http://h.org?x=/en/"), (None, "http://net/es/1"), (6, "http://c.net/es/"),
            (13, "x://u@H.com:80/p/q;r?s"), (14, "http://"), (15, "http://é.com/ü/"), (16, "http://q.org/" + "a/" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS tokens", "'x' AS rule")
    none = urls.mine_rules(spark.createDataFrame([], "url string, bad int"))
    got = {}
    for r in urls.judge(pages, RULES, none).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("a.example.com", "/en/1", "example.com/en/", "block")]
    assert got[2] == [("www.example.com", "/en/1", "www.example.com/en/", "allow")]
    assert got[3] == [("x.www.example.com", "/en/1", "www.example.com/en/", "allow")]
    assert got[4] == [("b.com", "", None, "allow")] and got[5] == [("b.com", "/x", "com/", "allow")]
    assert got[6] == [("c.net", "/es/", "net/es/", "block")] * 2 and got[7] == [("c.net", "/ES/", None, "allow")]
    assert got[8] == got[9] == got[10] == got[14] == [("", "", None, "allow")]
    assert got[11] == [("notexample.com", "/en/", "com/", "allow")] and got[12] == [("h.org", "", None, "allow")]
    assert got[None] == [("net", "/es/1", "net/es/", "block")] and got[13] == [("u@h.com:80", "/p/q;r", None, "allow")]
    assert got[15] == [("é.com", "/ü/", "com/", "allow")] and len(got) == 17


def test_url_mining_finds_planted_rules_like_brute_force(spark):
    import random
    from itertools import combinations
    rng = random.Random(3)
    rows = []
    for i in range(600):
        host, word, tail = rng.choice(["a.org", "b.org", "c.net"]), rng.choice(["x", "y"]), rng.choice(["", "?k=1", "#t"])
        bad = int(host == "a.org" and word == "x" and rng.random() < 0.95) or int(rng.random() < 0.05)
        rows.append((f"http://{host}/{word}/{i}{tail}", bad))
    rows += [(None, 1), ("http://a.org/x/1", None)]
    df = spark.createDataFrame(rows, "url string, bad int")
    mined = urls.mine_rules(df, min_support=0.02, min_confidence=0.8, min_count=5)
    rules = {tuple(sorted(r.tokens)): r.confidence for r in mined.collect()}
    sets = [(frozenset(r.t), r.bad) for r in df.where("bad is not null and url is not null").select(urls.tokens(df.url).alias("t"), "bad").collect()]
    every = sorted(set().union(*(s for s, _ in sets)))
    brute = {}
    for n in range(1, 8):
        for c in combinations(every, n):
            hit = [b for s, b in sets if s.issuperset(c)]
            if sum(hit) >= max(5, 0.02 * len(sets)) and sum(hit) / len(hit) >= 0.8:
                brute[c] = sum(hit) / len(hit)
    brute = {c: v for c, v in brute.items() if not any(set(d) < set(c) and w >= v for d, w in brute.items())}
    assert rules.keys() == brute.keys() and all(abs(rules[c] - brute[c]) < 1e-9 for c in rules)
    verdicts = {r.url: r.n_rules for r in urls.matching_urls(df, mined).collect()}
    for (u, b), s in zip([r for r in rows if r[0] and r[1] is not None], sets):
        assert verdicts.get(u, 0) == sum(s[0].issuperset(c) for c in brute)
