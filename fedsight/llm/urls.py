"""URL filters: hand-written host and path rules, then mined association rules.

Labelled URLs become sets of tokens (scheme, host labels, path words, file
extension, query keys, fragment). Spark's FP-growth mines token combinations;
rules "tokens -> bad" that pass support and confidence stay. A shorter rule
prunes a longer one that holds its tokens and has no higher confidence. URLs
meet the rules through an inverted index: each token of a URL fetches the rules
that name it, and a rule applies when as many of its tokens met as it has.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import broadcast_checked

BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the inverted index up to which it is broadcast.
MAX_BROADCAST_ROWS = 500_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z
    lower-cased; path: then up to ``?``, ``#`` or end. Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of rule and
    verdict; null if none does. A rule fits its host and its subdomains when the
    path starts with the rule's. The list is a bounded parameter."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; numbers are one token. Null or no ``://``: none."""
    host, path = host_and_path(url)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), x))
    words = F.transform(F.split(F.regexp_replace(F.lower(path), r"\.[a-z]+$", ""), "/"),
                        lambda x: F.concat(F.lit("path="), F.when(x.rlike("^[0-9]+$"), "#").otherwise(x)))
    query = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"),
                        lambda x: F.concat(F.lit("query="), F.regexp_extract(x, r"^[^=]*", 0)))
    rest = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1))),
                   F.concat(F.lit("ext="), F.regexp_extract(F.lower(path), r"\.([a-z]+)$", 1)),
                   F.concat(F.lit("fragment="), F.when(url.contains("#"), "#").otherwise("")))
    every = F.filter(F.concat(labels, words, query, rest), lambda x: ~x.rlike("=$"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = 0.002,
               min_confidence: float = 0.8, min_count: int = 30) -> DataFrame:
    """rule_id, tokens, n and confidence of the rules "tokens -> bad".

    ``labelled`` holds URLs and a 0/1 label; rows with a null label or without
    tokens are left out. No labelled rows: no rules. ``min_support`` is the share
    of labelled rows that hold the tokens and the label, ``min_count`` their
    least number.
    """
    baskets = labelled.where(F.col(bad_col).isNotNull()).select(
        F.when(F.size(tokens(F.col(url_col))) > 0, F.concat(tokens(F.col(url_col)), F.when(F.col(bad_col) == 1, F.array(F.lit(BAD)))
                                                            .otherwise(F.array().cast("array<string>")))).alias("items")
    ).where(F.col("items").isNotNull())
    n = baskets.count()
    empty = labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, n int, confidence double")
    if not n:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select(
        F.array_sort("antecedent").alias("tokens"), "confidence")
    rules = rules.select(F.xxhash64("tokens").alias("rule_id"), "tokens", F.size("tokens").alias("n"), "confidence")
    # Redundant rules: some shorter rule's tokens are all in it and its confidence is no higher.
    short = rules.select(F.col("rule_id").alias("s_id"), F.col("n").alias("s_n"), F.col("confidence").alias("s_c"),
                         F.explode("tokens").alias("token"))
    covered = (rules.select("rule_id", "n", "confidence", F.explode("tokens").alias("token")).join(short, "token")
               .where("s_n < n and s_c >= confidence").groupBy("rule_id", "s_id", "s_n").count().where("count = s_n"))
    return rules.join(covered, "rule_id", "left_anti")


def matching_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct URLs to which some mined rule applies, with their number of rules (n_rules)."""
    index = rules.select("rule_id", "n", F.explode("tokens").alias("token"))
    index = broadcast_checked(index, index.count(), MAX_BROADCAST_ROWS)
    each = urls.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
    met = each.select("url", F.explode_outer(tokens(F.col("url"))).alias("token")).join(index, "token")
    return (met.groupBy("url", "rule_id", "n").agg(F.count(F.lit(1)).alias("met")).where("met = n")
            .groupBy("url").agg(F.count(F.lit(1)).alias("n_rules")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], mined: DataFrame, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and n_rules (mined rules that apply) of
    every row.

    The longest fitting listed rule decides; without one the verdict is block if
    a mined rule applies, else allow (also for null and malformed URLs). Rows
    keep their number, repeated rows and null ids included; an empty table gives
    an empty result. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.join(matching_urls(rows, mined), "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))
    rows = rows.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    mined_verdict = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("listed.rule").alias("rule"),
                       F.coalesce("listed.verdict", mined_verdict).alias("verdict"), "n_rules")
