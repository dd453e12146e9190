"""Every corpus query runs over the smallest tables; the pipeline's stages hold to their contract."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from fedsight.llm.queries import QUERIES  # noqa: E402
from fedsight.session import checkpoint_dir  # noqa: E402

SF = "/root/testdata/sf0.001"
KEYS = {"op2_simhash_near_dedup": "doc_id", "op3_sentencepiece": "doc_id", "op4_html_extraction": "page_id", "op5_toxicity": "doc_id",
        "op6_url_filters": "page_id", "op7_quality_rules": "doc_id", "op8_sharding": "doc_id", "op9_language_id": "doc_id", "op11_lm_scoring": "doc_id", "op13_periodic_runs": "doc_id"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, name):
    df = QUERIES[name](spark, SF)
    if name in KEYS:
        table = spark.read.parquet(f"{SF}/{'pages' if KEYS[name] == 'page_id' else 'documents'}.parquet")
        assert sorted(r[0] for r in df.select(KEYS[name]).collect()) == sorted(r[0] for r in table.select(KEYS[name]).collect())
    else:
        assert df.count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert checkpoint_dir(spark)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from fedsight.llm.common import stage_table
        docs = stage_table(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(ids) and out.where("not same").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == n


def test_pipeline_on_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
