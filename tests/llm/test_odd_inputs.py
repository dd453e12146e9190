"""Inputs that every crawl holds: class names that mention template words, broken and deep pages, texts
without white space, repeated ids, nulls in the pipeline."""

import time

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from fedsight.llm import html, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("page,want", [
    ('<div class="page has-sidebar"><article><p>one</p><p>two</p></article></div>', "one\n\ntwo"),
    ('<article class="content no-banner"><p>one</p></article>', "one"),
    ('<article><section class="share-price"><p>one</p></section></article>', "one"),
    ('<main><div class="related-work"><p>one</p></div></main>', "one"),
    ('<article><div class="social-history"><p>one</p></div></article>', "one"),
    ('<article><p>one</p><div class="advert">x</div><div class="comment-list">y</div><div id="site-footer">z</div></article>', "one"),
    ('<article><p>one</p><div class="box cookie-notice">x</div></article><div class="share-buttons">s</div>', "one"),
    ('<div class="notice"><p>all there is</p></div>', "all there is"),
    ('<div><p>no article</p><nav>x</nav><div class="sidebar-left">y</div></div>', "no article")])
def test_names_that_mention_template_words(page, want):
    assert html.main_text(page) == want


def test_tree_decides_for_pages_without_article(spark):
    """Unknown class names: what all pages of a host repeat goes, what differs stays."""
    rows = [(i, f"http://h/{i}", f'<div class="zq"><div class="kx">Same on all pages</div><div class="vw"><p>Text number {i} of {i * 7}</p></div></div>')
            for i in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text number {i} of {i * 7}" for i in range(8)}


def test_deep_pages_cost_no_jobs(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    rows = [(1, "http://a/1", deep), (2, "http://b/1", "<p>x</p>"), (3, "http://b/2", "<p>y</p>"), (4, None, None)]
    began = time.time()
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "core", 2: "x", 3: "y", 4: ""} and time.time() - began < 60


def test_folding_is_linear():
    began = time.time()
    for t in ("a1" * 500_000, "x" * 1_000_000, "漢字" * 500_000 + "1", "!" * 1_000_000):
        toxicity.folded(t)
    assert time.time() - began < 10
    assert toxicity.folded("w0rd plain l1ke (th1s)! 123").split() == toxicity.folded("word plain like this 123").split()


def test_repeated_ids_lose_no_text(docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"q{i}" for i in range(60))
    rows = [(1, long), (1, other), (2, long), (3, other + " tail"), (1, long), (None, long), (4, None), (5, ""), (None, None)]
    out = simhash.deduplicate(docs_of(rows, "fp", "root"))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got.count((1, long)) == 1 and got.count((1, other)) == 1 and (2, long) not in got
    assert sum(r[0] is None for r in got) == 2 and [r for r in got if r[0] in (4, 5)] == [(4, None)]
    assert out.columns == docs_of(rows, "fp", "root").columns


def test_pipeline_stages_on_nulls_and_repeats(spark, docs_of):
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 500 and 3000").select("text").limit(3).collect()
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, prose[0].text), (4, prose[0].text), (4, prose[1].text), (None, prose[2].text), (5, "x" * 50_000)]
    docs = docs_of(rows, "score", "fp", "ids")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        texts = {r.text for r in out.collect()}
        assert {prose[0].text, prose[1].text, prose[2].text} <= texts, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
