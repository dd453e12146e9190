"""Operators with fitted models or parsers: toxicity, language, pieces, pages."""

import json
import math
import random

import pytest

from fedsight.llm import html, langid, pieces, toxicity


# --- toxicity -------------------------------------------------------------
def test_folding():
    f = toxicity.folded
    assert f("You 1D10T!") == " you idiot " and f("ѕtuріd l0ser.") == " stupid loser " and f("Trásh-can, $cum") == " trash can scum "
    assert f("in 2024 at 10:30") == " in 2024 at 10 30 " and f(None) == f("") == f(" \n") == " " and f("sc​um") == " scum "


def naive(lexicon, text):
    """Hits by trying every word of a folded text against every term and phrase."""
    t = toxicity.folded(text)
    spans = []
    for p in lexicon.phrases:
        p, at = toxicity.folded(p), -1
        while len(p) > 2 and (at := t.find(p, at + 1)) >= 0:
            spans.append((at, at + len(p) - 1))
    out = []
    for i, c in enumerate(t):
        fits = [x for x in lexicon.terms if c == " " and t.startswith(x, i + 1)]
        if fits:
            best = max(fits, key=len)
            e = i + len(best)
            if not any(a <= i and e <= b for a, b in spans):
                out.append((i, e, lexicon.terms[best]))
    return out


def test_automaton_matches_naive_search():
    lexicon = toxicity.Lexicon({"trash": 3.0, "idiot": 4.0, "lo": 1.0, "loser": 5.0, "clown": 2.0}, ["trash can", "clown fish", "lobster", "", "!"])
    rng = random.Random(3)
    bits = ["trash", "can", "trash can", "idiots", "lost", "losers", "lobster", "lobsters", "clown", "fish", "ok", "l0ser", "Clown-Fish", ",", "\n"]
    a = lexicon.automaton()
    for _ in range(500):
        t = " ".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert toxicity.match(a, toxicity.folded(t)) == naive(lexicon, t), t
    assert toxicity.match(toxicity.Lexicon({}, []).automaton(), " x ") == []


def labelled(n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.randint(20, 200))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["grubwort", "zonk" + rng.choice(plain), "frizzle"]))
        elif rng.random() < 0.1:
            w.insert(3, "frizzleberry")
        elif i % 90 == 0:
            w.insert(2, "zonkberry")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_holds_out(spark, docs_of):
    rows, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs_of(rows, "toxic", "key"), lab.where("doc_id % 3 != 1"))
    assert {"grubwort", "zonk", "frizzle "} == set(lexicon.terms) and "zonkberry" in lexicon.phrases
    extra = [(10_000, "you are gru8w0rt and zоnkban"), (10_001, None), (10_002, ""), (10_003, "12 34 ..."), (10_003, "12 34 ..."), (None, "grubwort " * 30_000)]
    df = docs_of(rows + extra, "score", "n_hits")
    got = {}
    for r in df.select("doc_id", toxicity.score(df.text, lexicon).alias("s")).collect():
        got.setdefault(r.doc_id, []).append(r.s)
    held = [(got[i][0].score >= 0.7) == bool(y) for i, y in labels if i % 3 == 1]
    assert sum(held) / len(held) > 0.97
    assert got[10_000][0].score >= 0.7 and got[None][0].score >= 0.7 and len(got[10_003]) == 2
    assert all(got[i][0].score < 0.1 and got[i][0].n_hits == 0 for i in (10_001, 10_002, 10_003))
    kept = toxicity.clean(df, lexicon)
    assert kept.columns == df.columns and {10_001, 10_002} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id is null").count() == 0


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs_of([(1, "a b")]), none)
    assert lexicon.terms == {} and toxicity.learn(docs_of([]), spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")).terms == {}
    df = docs_of([(1, "a b"), (2, None)])
    assert toxicity.clean(df, lexicon).count() == 2 and toxicity.clean(docs_of([]), lexicon).count() == 0


# --- language -------------------------------------------------------------
WORDS = {"en": "the of and with this that from they have which their would there about could", "de": "der und die nicht auch werden sich eine durch über zwischen schon können während",
         "fr": "les des dans pour avec être cette mais plusieurs toujours aussi où après était", "es": "los las para con como pero más este también porque entre cuando muy sobre",
         "qq": "xqz qzx zzq xxq qqz zqx"}


def speech(lang, n, rng):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


def test_language_profile_blocks(monkeypatch):
    t = "Ünïcode, text 123 with gaps!\n" * 50
    whole = langid.profile(t)
    assert math.isclose(float((whole ** 2).sum()), 1) and langid.profile("12 -- 3") is None and langid.profile(None) is None
    monkeypatch.setattr(langid, "BLOCK", len("Ünïcode, text 123 with gaps!\n") * 10)
    assert abs(langid.profile(t) - whole).max() < 1e-9


def test_language_fit_and_predict(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, speech(g, rng.randint(15, 60), rng), g) for i, g in enumerate(rng.choices(list(WORDS), k=500))]
    taught = docs_of(rows[:400] + [(9001, None, "en"), (9002, "...", "de"), (9003, "the of", None), (None, "the", "fr")], "x", "y", "n")
    model = langid.fit(taught, per_lang=60)
    assert sorted(model.families) == ["germanic", "qq", "romance"] and sorted(model.pairs) == [("de", "en"), ("es", "fr")]
    df = docs_of(rows[400:] + [(9001, None), (9002, "12 !?"), (9003, ""), (9004, "the of and " * 60_000), (9004, "the of and")], "lang_pred", "score")
    got = {}
    for r in df.select("doc_id", langid.predict(df.text, model).alias("p")).collect():
        got.setdefault(r.doc_id, []).append(r.p)
    assert sum(got[i][0].lang_pred == g for i, _, g in rows[400:]) >= 97
    assert all(0 <= p.score <= 1 for ps in got.values() for p in ps)
    assert [got[i][0].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and [p.lang_pred for p in got[9004]] == ["en", "en"]
    kept = langid.known(df, model)
    assert kept.columns == df.columns and not {9001, 9002, 9003} & {r.doc_id for r in kept.collect()}


def test_language_degenerate_models(docs_of):
    nobody = langid.fit(docs_of([]))
    assert nobody.predict("some text") == ("und", 0.0)
    one = langid.fit(docs_of([(1, "only this", "en"), (2, "and that", "en")]))
    assert one.predict("anything") == ("en", 1.0) and one.predict("1") == ("und", 0.0)
    pair = langid.fit(docs_of([(i, speech(g, 40, random.Random(i)), g) for i in range(20) for g in ("en", "de")]))
    assert pair.predict("the which there")[0] == "en" and pair.predict("nicht über zwischen")[0] == "de"


def test_every_language_is_learned(docs_of):
    """More languages than 64: the rarest is learned, too, and the rows are bounded."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    codes = [f"q{a}{b}" for a in letters[:5] for b in letters[:14]]
    word = {g: " ".join(c * 3 for c in g[1:]) for g in codes}
    rows = [(100 * n + j, f"{word[g]} " * (5 + j), g) for n, g in enumerate(codes) for j in range(3 if n < 69 else 2)]
    model = langid.fit(docs_of(rows), per_lang=3, max_rows=140)
    assert sorted(model.families) == sorted(codes) and len(codes) == 70
    assert model.predict(f"{word[codes[-1]]} " * 9)[0] == codes[-1]


# --- pieces ---------------------------------------------------------------
def edge_texts():
    rng = random.Random(9)
    out = ["", " ", "  hello   world\n x\ty\xa0é €𐍈", "ﬁ Ⅳ <s> <unk> </s> <0x0A>", "▁a▁▁b", "\n\n", "a" * 500, "  " * 50, "é̂", "​﻿x", "日本語 テキスト", "   a", "a   ",
           "\x00a", "🙂🙂 x"]
    return out + ["".join(rng.choices(" ▁aeiouthrsn.,\n\té€𐍈<>s/unk0xA", k=rng.randint(0, 40))) for _ in range(300)]


def test_pieces_equal_the_reference_library(spark, docs_of):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    texts = edge_texts() + ["word ever new " * 40_000]
    df = docs_of([(i, t) for i, t in enumerate(texts)] + [(0, None), (0, None), (None, "x")], "ids", "same", "e")
    codec = pieces.Codec(spark, parity_every=1)
    got = pieces.encode_documents(df, codec)
    rows = got.collect()
    assert len(rows) == len(texts) + 3
    by_id = {r.doc_id: r for r in rows if r.doc_id}
    for i, t in enumerate(texts):
        if i:
            assert by_id[i].ids == sp.encode(t) and by_id[i].n_pieces == len(by_id[i].ids) and by_id[i].same
    assert [r.ids for r in rows if r.doc_id == 0] == [[], [], []]
    back = {r.doc_id: r.text for r in got.where("doc_id > 0").select("doc_id", codec.decode(got.ids).alias("text")).collect()}
    assert all(back[i] == pieces.normal_form(t) == sp.decode(sp.encode(t)) for i, t in enumerate(texts) if i)
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert {r.t for r in none.select(codec.decode(none.ids).alias("t")).collect()} == {None, ""}
    assert pieces.encode_documents(docs_of([]), codec).count() == 0


def unigram_model(spaces: bool) -> bytes:
    """A small hand-made unigram model with byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    for p, s, kind in ([("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
                       + [(p, -1.0 - i / 7, 1) for i, p in enumerate(["▁the", "▁", "the", "re", "e", "r", "t", "h", "▁a", "a", "n", "d", "and", "▁there"])]):
        m.pieces.add(piece=p, score=s, type=kind)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = spaces
    m.normalizer_spec.escape_whitespaces = True
    return m.SerializeToString()


@pytest.mark.parametrize("spaces", [False, True])
def test_unigram_models(spaces):
    import sentencepiece
    raw = unigram_model(spaces)
    sp, engine = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces._Engine(pieces.rebuild(raw), 2, 1000)
    texts = ["the there and", "  a   hen ", "ether", "théa", "x", "", "and  the"]
    ids, _ = engine.encode(texts)
    assert [i.tolist() for i in ids] == sp.encode(texts)
    assert engine.decode([i.tolist() for i in ids]) == [sp.decode(i.tolist()) for i in ids]


def test_new_words_are_verified_together_in_bounded_batches():
    import sentencepiece
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        raw = f.read()
    sp, given = sentencepiece.SentencePieceProcessor(model_proto=raw), []

    class Counting:
        def __getattr__(self, name):
            return getattr(sp, name)

        def encode(self, texts, **more):
            given.append(len(texts))
            return sp.encode(texts, **more)
    engine = pieces._Engine(pieces.rebuild(raw), 2, reference=Counting())
    rng = random.Random(4)
    texts = ["".join(rng.choices("aeioustrn ", k=60_000)) + " " * k for k in range(4)] + edge_texts()
    ids, same = engine.encode(texts)
    assert [i.tolist() for i in ids] == sp.encode(texts) and all(same)
    assert sum(given) < len(engine.words) / 20 and max(given) <= pieces.WORDS_AT_ONCE       # words are not checked one by one
    engine.encode(["x" * (pieces.MOST_HELD + 1)])
    engine.encode(["a b"])
    assert engine.held == sum(map(len, engine.words)) < 100         # long words are not held for ever
    engine.tokenizer.model = type(engine.tokenizer.model)({p: i for p, i in engine.tokenizer.get_vocab().items()}, [], unk_token="<unk>", byte_fallback=True)
    with pytest.raises(ValueError, match="text 'house'"):
        engine.encode(["a b house"])


def test_words_are_encoded_together_and_stay_while_they_are_met():
    """Before, each new word was encoded on its own, and a word that the batch at
    hand lacked was forgotten, and met again, whenever the words were too many."""
    import sentencepiece
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    engine, given = pieces._Engine(pieces.rebuild(raw), 2, 3_000, reference=sp), []
    library = engine.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return library.encode_batch_fast(texts, **more)
    engine.tokenizer = Counting()
    words = [f"w{chr(97 + i % 26)}{i}é" for i in range(40_000)]
    common, rare = words[:1_000], words[1_000:]
    for i in range(0, 39_000, 1_000):
        texts = [" ".join(rare[i:i + 1_000]), " ".join(common[i // 1_000 % 2::2])]      # a common word is in every other batch
        ids, same = engine.encode(texts)
        assert [x.tolist() for x in ids] == sp.encode(texts) and all(same)
        assert len(engine.words) < 8_000 and engine.held == sum(map(len, engine.words))
    assert len(given) < 500 and all(isinstance(x, str) for x in given)
    assert sum(x.count(pieces.MARK) for x in given) == len(words)       # each is met once


@pytest.mark.parametrize("prefix", [False, True])
def test_gaps_of_any_width(prefix):
    """Texts that begin or end with gaps, wide gaps and marks, with and without the model's own prefix."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        bpe = f.read()
    rng = random.Random(3)
    texts = ["", " ", "  ", "a", " a", "a ", "  a  b   ", "▁", "▁ ▁a▁", "a \n b", "\n", " \t "] + ["".join(rng.choices("  ▁ae\n", k=rng.randint(0, 9))) for _ in range(500)]
    for raw in (unigram_model(False), bpe):
        m = pb.ModelProto()
        m.ParseFromString(raw)
        m.normalizer_spec.add_dummy_prefix = prefix
        raw = m.SerializeToString()
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        engine = pieces._Engine(pieces.rebuild(raw), 2, 100, reference=sp)
        assert engine.by_word
        for i in range(0, len(texts), 50):
            ids, same = engine.encode(texts[i:i + 50])
            assert [x.tolist() for x in ids] == sp.encode(texts[i:i + 50])
            assert all(same)
    assert engine.encode([]) == ([], []) and [len(x) for x in engine.encode(["", ""])[0]] == [0, 0]


def test_every_row_is_verified_and_decoded(spark, docs_of, monkeypatch):
    """A word that the reference library encodes in another way fails the job on
    any row, and ``same`` tells what the ids decode to."""
    codec = pieces.Codec(spark)
    rows = [(i, "plain words") for i in range(30)] + [(30, "plain zebra  ")]
    assert all(r.same for r in pieces.encode_documents(docs_of(rows), codec).coalesce(1).collect())
    import sentencepiece
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    odd = next(w for w in ("different", "important", "water", "system", "house") if len(sp.encode(w)) == 1)
    other = json.loads(pieces.rebuild(raw))
    other["model"]["merges"] = [m for m in other["model"]["merges"] if "".join(m).replace(" ", "") != pieces.MARK + odd]
    codec.json = spark.sparkContext.broadcast(json.dumps(other))
    assert pieces.encode_documents(docs_of(rows[:30]), codec).count() == 30
    with pytest.raises(Exception, match="differ from the reference"):
        pieces.encode_documents(docs_of([*rows[:30], (30, "plain " + odd)]).coalesce(1), codec).collect()
    engine = pieces._Engine(pieces.rebuild(raw), 1)
    monkeypatch.setattr(engine, "decode", lambda ids: ["another text" for _ in ids])
    assert engine.encode(["plain words"])[1] == [False]


# --- pages ----------------------------------------------------------------
def test_page_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Menu</a></ul></nav>
    <!-- note --><div class="ad">Buy</div><header>Top</header><article><header><h1>A &amp; B&nbsp;C</h1></header><p><b>One
      two<br>three<p>Four <script>x</script>five</p><ul><li>six<li>seven</ul><div class="comments"><p>me!</p></div><form><input><p>mail</p></form>
      <p>a &lt;b&gt; &#233;&hellip;</p><aside>side</aside>tail</article><section id="comments"><article class="comment">no</article></section><footer>&copy;</footer></body>"""
    assert html.main_text(page) == "A & B C\n\nOne two three\n\nFour five\n\nsix\n\nseven\n\na <b> é…\n\ntail"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> \n</p>") == ""
    assert html.main_text("plain <text") == "plain" and html.main_text("<div><p>a<div>b</div>c</div><nav>n") == "a\n\nb\n\nc"
    assert html.main_text("<p>x</p></div></p><p>y</article>") == "x\n\ny"
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert html.main_text(deep) == "core" and html.main_text("<script>" + "x" * 10**6) == "" and len(html.main_text("<p>w</p>" * 20_000)) == 3 * 20_000 - 2


def shop(i, body):
    return (f"<html><body><div class='top'><span>Shop of things</span></div><div class='box'><p>Sign up for our letter</p></div>"
            f"<div class='text'><p>{body}</p></div><div class='end'>About us</div></body></html>")


def test_site_style_tree_removes_what_a_host_repeats(spark):
    rows = [(i, f"http://shop.org/{i}", shop(i, f"Thing number {i} has its own story {i * 7}.")) for i in range(12)]
    rows += [(100, "http://lone.org/1", shop(1, "One page only.")), (101, None, "<p>x</p>"), (102, "bad url", None), (103, "http://shop.org/a", ""), (100, "http://lone.org/1", shop(1, "One page only."))]
    rows += [(200 + i, "http://copy.org/x", "<body><div>All the same</div></body>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "'c' AS path", "'c' AS removed", "'c' AS text")
    got = {}
    for r in html.extract(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for i in range(12):
        assert got[i] == [f"Thing number {i} has its own story {i * 7}."]
    whole = "Shop of things\n\nSign up for our letter\n\nOne page only.\n\nAbout us"
    assert got[100] == [whole, whole] and got[101] == ["x"] and got[102] == [""] and got[103] == [""] and got[200] == ["All the same"]
    assert html.extract(pages.limit(0)).count() == 0


def test_importance_by_hand(spark):
    """Two pages share a layout; the tree's values follow from the formulas."""
    a, b = "<body><div class='x'>same</div><div class='y'>one</div></body>", "<body><div class='x'>same</div><div class='y'>two</div></body>"
    pages = spark.createDataFrame([(1, "http://h/1", a), (2, "http://h/2", b)], "page_id long, url string, html string")
    got = sorted(round(r.importance, 6) for r in html.style_tree(pages).collect())
    # body: one style over two pages, own 0; children 0 (same text) and 1 (other texts): 0.9 * 0.5.
    assert got == [0.0, 0.45, 1.0]


def test_style_tree_reaches_deep_and_wrapped_blocks(spark):
    deep = "<html><body>" + "<div>" * 20 + "<p>Deep story {0} of its own.</p>" + "</div>" * 20 + "<div class='end'>Same end</div>"
    wrapped = ("<html><body><div class='a'><span><font><div><p>Wrapped story {0} of its own.</p></div></font></span></div>"
               "<div class='b'><x-card><div>Same card</div></x-card></div></body></html>")
    rows = [(i, "http://deep.org/x", deep.format(i)) for i in range(3)] + [(10 + i, "http://wrap.org/x", wrapped.format(i)) for i in range(3)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Deep story {i} of its own." for i in range(3)} | {10 + i: f"Wrapped story {i} of its own." for i in range(3)}
