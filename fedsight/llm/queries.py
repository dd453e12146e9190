"""The ``opN_<name>`` queries over the shared tables, with DuckDB SQL where SQL
can express them. Each is a thin wrapper that calls its operator on the whole
table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsight.llm import decontaminate, html, interactions, langid, licenses, maxent, periods, pieces, quality, sharding, simhash, toxicity, urls
from fedsight.llm.common import by_value, fold
from fedsight.llm.sql import DECONTAMINATION_SQL, LICENSE_SQL, QUALITY_SQL
from fedsight.sources.tables import load

by_value(__name__)

#: Fixed values of the URL contract: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(load(spark, sf_dir, "documents"), k=3, max_bits=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(load(spark, sf_dir, "documents"), pieces.Codec(spark))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def toxicity_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    """Lexicon of the rows whose labels may be learned (remainder not 1)."""
    return toxicity.learn(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = toxicity.score(F.col("text"), toxicity_lexicon(spark, sf_dir))
    return (load(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), s.alias("s"))
            .select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.7).cast("int").alias("predicted"), "s.n_hits"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels")
    # A page's label is that of the document that its path names.
    source = F.regexp_extract("url", r"/([0-9]+)(?:\.[a-z]+)?/?(?:[?#].*)?$", 1)
    labelled = (pages.select("url", F.when(source != "", source).cast("long").alias("doc_id")).join(labels, "doc_id")
                .select("url", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")))
    return urls.judge(pages, URL_RULES, urls.mine_rules(labelled))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.judged(docs, quality.references(docs))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def language_model(docs: DataFrame) -> langid.Model:
    """Model of the rows that may be learned from (remainder not 0)."""
    return langid.fit(docs.where(fold(F.col("doc_id"), 5) != 0))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    p = langid.predict(F.col("text"), language_model(docs))
    return docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), p.alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(load(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(interactions.failing(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def repeated_from(g: int, n: int) -> np.ndarray:
    """Fixed rule of the run contract: from word a on, every word is one of the p words there."""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    found = periods.detect(load(spark, sf_dir, "documents"), edit=(F.when(h % 10 == 0, F.floor(h / 10)), repeated_from))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumns({"lines": lines, "top": longest}).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", (-F.col("top.less")).alias("length"), "top.period",
        F.floor(1000 * -F.col("top.less") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_license_scan, op2_simhash_near_dedup, op3_sentencepiece, op4_html_extraction, op5_toxicity, op6_url_filters, op7_quality_rules,
    op8_sharding, op9_language_id, op10_benchmark_decontamination, op11_lm_scoring, op12_filter_interactions, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op1_license_scan": LICENSE_SQL, "op7_quality_rules": QUALITY_SQL,
                           "op10_benchmark_decontamination": DECONTAMINATION_SQL,
                           "op12_filter_interactions": interactions.INTERACTIONS_SQL}
