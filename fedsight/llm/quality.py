"""Quality rules: distribution divergence from language references.

A document's histogram of character classes and its histogram of common words
are compared with references of each language, which are counted over all
documents of that language, by the Jensen-Shannon distance (base 2, so between
0 and 1). The nearest language judges. Short texts have noisy histograms, so
each test has a least length. Everything is a row-local expression over arrays:
no document is exploded or shuffled; only the references aggregate, over the
fixed word list, to one row a language.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import WHITE_CLASS, white_words

#: Frequent words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this",
           "at", "from", "or", "an"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein",
           "eine", "als", "auch", "es", "an", "er"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas",
           "au", "sur", "ne", "se", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al",
           "lo", "como", "más", "o"],
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: Punctuation of prose; stripped from words before they are looked up.
PUNCTUATION = r"[.,;:!?'\"()\-]+"
SYMBOLS = "[#*$%&|<>]+"
CLASSES = ["letter", "space", "digit", "punctuation", "other"]


def with_classes(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and, of column ``t``, ``cc`` (counts of the classes in
    the order of CLASSES) and ``n_symbols``. Classes are taken away one by one,
    so each pass reads what the earlier ones left."""
    out, at = rows.withColumn("r", F.col("t")), []
    for name, pattern in [("letter", r"\p{L}+"), ("space", f"[{WHITE_CLASS}]+"), ("digit", "[0-9]+"),
                          ("punctuation", PUNCTUATION), ("n_symbols", SYMBOLS)]:
        out = out.select(*keep, "t", *at, F.col("r").alias("q"), F.regexp_replace("r", pattern, "").alias("r"))
        out = out.select(*keep, "t", *at, (F.length("q") - F.length("r")).cast("long").alias(name), "r")
        at.append(name)
    cc = F.array("letter", "space", "digit", "punctuation", F.col("n_symbols") + F.length("r"))
    return out.select(*keep, "t", cc.alias("cc"), "n_symbols")


def plain_words(text: Column) -> Column:
    """Lower-cased words without the punctuation of prose."""
    return white_words(F.lower(F.regexp_replace(text, PUNCTUATION, "")))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Class shares and word shares (WORDS, then all other words) of each
    language of COMMON_WORDS that has a document, counted over all documents of
    it; null languages and texts are left out."""
    rows = docs.where(F.col(lang_col).isin(list(COMMON_WORDS)) & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    chars = [F.sum(F.col("cc")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    total = {r["lang"]: r for r in with_classes(rows, "lang").groupBy("lang").agg(*chars).collect()}
    word = rows.select("lang", F.explode_outer(plain_words(F.col("t"))).alias("word")).where(F.col("word").isNotNull())
    word = word.select("lang", F.when(F.col("word").isin(WORDS), F.col("word")).otherwise("").alias("word"))
    count = {(r[0], r[1]): r[2] for r in word.groupBy("lang", "word").count().collect()}
    out = {}
    for lang, r in sorted(total.items()):
        c, k = [r[f"c{i}"] for i in range(len(CLASSES))], [count.get((lang, w), 0) for w in [*WORDS, ""]]
        out[lang] = ([x / max(1, sum(c)) for x in c], [x / max(1, sum(k)) for x in k])
    return out


def _doubles(xs: list[float]) -> str:
    return "array(" + ",".join(f"{x!r}D" for x in xs) + ")"


def _bin(p: str, q: float) -> str:
    """Term of one bin of p ln p + q ln q - (p + q) ln((p + q) / 2), which is
    2 ln 2 times its share of the Jensen-Shannon divergence (base 2), as SQL."""
    qlnq = q * math.log(q) if q else 0.0
    return f"(if({p} > 0, {p} * ln({p}), 0D) + {qlnq!r}D - if({p} + {q!r}D > 0, ({p} + {q!r}D) * ln(({p} + {q!r}D) / 2), 0D))"


def judged(docs: DataFrame, refs: dict[str, tuple[list[float], list[float]]], id_col: str = "doc_id", text_col: str = "text",
           lang_col: str = "lang", max_class_distance: float = 0.2, max_word_distance: float = 0.36, min_chars: int = 200, min_words: int = 100) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, nearest (language), class_distance, word_distance and kept of
    every row.

    kept is false when the base rules fail (under 50 words, or over half of the
    words in 3-word windows that repeat), or when the nearest language's class
    distance (texts of ``min_chars`` or more) or word distance (texts of
    ``min_words`` words or more) is over its bound. A document whose language is
    named in ``lang_col`` (if there is such a column) but has no reference is
    not held against the references of others. The nearest language has the
    least sum of both distances, ties by name. Null texts are empty: no words,
    base_failed. Without references nothing diverges. Rows keep their number;
    an empty table gives an empty result. Other columns are not read. Windows
    are compared by their 64-bit hashes within a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(named.isin(list(refs)), F.lit(True)).alias("known"), text.alias("t"))
    rows = with_classes(rows, "doc_id", "known").select("doc_id", "known", "cc", "n_symbols", white_words(F.col("t")).alias("w"),
                                               F.split("t", "\n").alias("lines"), plain_words(F.col("t")).alias("pw"))
    listed = ",".join("'" + w.replace("'", "''") + "'" for w in WORDS)
    n_chars = F.aggregate("cc", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.select(
        "doc_id", "known", "cc", "n_symbols", F.size("w").cast("long").alias("n_words"), F.size("pw").alias("n_plain"), n_chars.alias("n_chars"),
        F.expr(r"filter(lines, x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr("if(size(w) >= 3, transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])), cast(array() as array<bigint>))").alias("g"),
        F.expr(f"sort_array(filter(pw, x -> x in ({listed})))").alias("hits"))
    rows = rows.withColumn("word_chars", F.col("n_chars") - F.col("cc")[CLASSES.index("space")])
    rows = rows.withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        # Only texts with a repeated window are sorted: (hash, place), equal neighbours are repeats.
        "s": F.when(F.size(F.array_distinct("g")) < F.size("g"), F.expr("sort_array(transform(g, (x, i) -> struct(x, i)))")),
        "d": F.array_distinct("hits")})
    rows = rows.withColumns({
        "rep": F.expr("filter(s, (e, i) -> (i > 0 and get(s, i - 1).x = e.x) or get(s, i + 1).x = e.x)"),
        "k": F.expr("transform(d, (x, i) -> if(i + 1 < size(d), array_position(hits, d[i + 1]), size(hits) + 1) - array_position(hits, x))"),
        "at": F.expr(f"transform(d, x -> array_position(array({listed}), x))")})
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.expr(
        "size(array_distinct(flatten(transform(rep, e -> array(e.i, e.i + 1, e.i + 2)))))").cast("long"), F.lit(0).cast("long")))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("s").isNull(), 0).otherwise(F.col("n_repeat_words")).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumns({"p": F.expr("transform(k, x -> x / n_plain)"), "shares": F.expr("transform(cc, x -> x / greatest(n_chars, 1))"),
                             "p_rest": F.expr("(n_plain - size(hits)) / greatest(n_plain, 1)")})
    rows = rows.withColumn("plnp", F.expr("aggregate(p, 0D, (a, x) -> a + x * ln(x))"))
    scale = 2 * math.log(2)
    for lang, (cq, wq) in refs.items():
        cls = "+".join(_bin(f"shares[{i}]", q) for i, q in enumerate(cq))
        # A listed word that the text lacks adds q ln 2; r takes that from those it has.
        q, r = _doubles(wq[:-1]), _doubles([(x * math.log(x) if x else 0.0) - x * math.log(2) for x in wq[:-1]])
        hit = (f"plnp + {math.log(2) * sum(wq[:-1])!r}D + aggregate(zip_with(p, at, (x, u) -> {r}[u - 1] - (x + {q}[u - 1]) * "
               f"ln((x + {q}[u - 1]) / 2)), 0D, (a, x) -> a + x)")
        rows = rows.withColumns({
            f"c_{lang}": F.expr(f"if(n_chars > 0, sqrt(greatest(0D, {cls}) / {scale!r}D), 1D)"),
            f"w_{lang}": F.expr(f"if(n_plain > 0, sqrt(greatest(0D, {hit} + {_bin('p_rest', wq[-1])}) / {scale!r}D), 1D)")})
    if refs:
        near = F.array_min(F.array(*[F.struct(F.round(F.col(f"c_{x}") + F.col(f"w_{x}"), 9).alias("sum"), F.lit(x).alias("lang"),
                                              F.round(f"c_{x}", 6).alias("c"), F.round(f"w_{x}", 6).alias("w")) for x in sorted(refs)]))
    else:
        near = F.lit(None).cast("struct<sum:double,lang:string,c:double,w:double>")
    rows = rows.withColumn("near", near)
    far = (((F.col("n_chars") >= min_chars) & (F.col("near.c") > max_class_distance))
           | ((F.col("n_plain") >= min_words) & (F.col("near.w") > max_word_distance)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       F.col("near.lang").alias("nearest"), F.col("near.c").alias("class_distance"), F.col("near.w").alias("word_distance"),
                       (~F.col("base_failed") & ~(F.col("known") & F.coalesce(far, F.lit(False)))).alias("kept"))
