"""How filters of documents act on each other, in every order.

Words are numbered by a dictionary of the whole table: a word's term number is
its 63-bit hash, the dictionary holds every word of the table once, and it is
checked that no two words have one number; words that clash get negative
numbers of their own and the texts are read again. So all tasks number alike
and neither words nor texts have to be shuffled for it. The documents of a
batch become a shard of the sparse document-term matrix (CSR: row pointer, term
numbers, counts): a row's sum is its number of words, its nonzero counts are
its distinct words. What is left is a table of (part, failing filters, labels)
-> documents, whose size does not depend on the documents; all orders are read
off it.

Copies are counted, not joined: rows are grouped by the digest of their text,
and all but those with the least id of the digest repeat an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedsight.llm.common import WHITE_CLASS, by_value, small_batches, stage_table

by_value(__name__)

FILTERS = "ABCDE"
#: A task gives its words to the dictionary when it has met so many different ones.
WORDS_AT_ONCE = 500_000
#: Words whose hashes clash; beyond this the hash is too narrow for the table.
MAX_CLASHES = 100_000


def csr(rows: np.ndarray, words: np.ndarray, terms: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointer, term numbers and counts of the matrix of word occurrences
    (``rows``, ``words``), word i being term ``terms[i]``; a row's terms stand once."""
    names, column = np.unique(terms, return_inverse=True)
    width = max(len(names), 1)
    cells, counts = np.unique(rows * width + column[words], return_counts=True)
    return np.searchsorted(cells, np.arange(n_rows + 1) * width), names[cells % width] if len(cells) else cells, counts


def _measured(rows: DataFrame, keep: list[str], symbols: str, recoded: dict[bytes, int], bits: int, words_at_once: int) -> DataFrame:
    """Staged rows of two kinds: ``keep`` with n_words, n_distinct, n_capitals,
    n_points and symbols of a text, and a word (null for texts)."""
    capitals, following, marks = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), symbols.encode()
    facts = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        terms: list[int] = []
        kinds = None

        def number(word: bytes) -> int:
            terms.append(recoded[word] if word in recoded else xxhash.xxh64_intdigest(word, 42) >> (64 - bits))
            seen[word] = len(terms) - 1
            return len(terms) - 1

        def dictionary() -> pa.RecordBatch:
            n = len(seen)
            return pa.RecordBatch.from_arrays([*(pa.nulls(n, k) for k in kinds), *(pa.nulls(n, pa.int64()) for _ in facts), pa.array(list(seen), pa.binary())],
                                              [*keep, *facts, "word"])

        for batch in batches:
            kinds = [batch.column(c).type for c in keep]
            texts = [t.as_py() or b"" for t in batch.column("text")]
            found, sizes = [], []
            for t in texts:
                words = t.split()
                sizes.append(len(words))
                found.append(np.fromiter((seen[w] if w in seen else number(w) for w in words), dtype=np.int64, count=len(words)))
            flat, used = np.unique(np.concatenate(found), return_inverse=True) if found else (np.zeros(0, np.int64),) * 2
            own = np.array([terms[i] for i in flat], dtype=np.int64)
            pointer, _, counts = csr(np.repeat(np.arange(len(texts)), sizes), used, own, len(texts))
            total = np.concatenate(([0], np.cumsum(counts)))
            made = [total[pointer[1:]] - total[pointer[:-1]], np.diff(pointer), *(
                np.array([len(t) - len(t.translate(None, drop)) for t in texts], dtype=np.int64) for drop in (capitals, following, marks))]
            made[3] = np.array([len(t) for t in texts], dtype=np.int64) - made[3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in made), pa.nulls(len(texts), pa.binary())],
                                             [*keep, *facts, "word"])
            if len(seen) >= words_at_once:
                yield dictionary()
                seen.clear()
                terms.clear()
        if seen:
            yield dictionary()

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} bigint" for c in facts), "word binary"])
    return stage_table(rows.mapInArrow(run, schema), "term-counts")


def measures(rows: DataFrame, keep: list[str], symbols: str, bits: int = 63, words_at_once: int = WORDS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """Of every row (``text`` as binary): the ``keep`` columns, n_words and
    n_distinct (row sum and nonzero counts of the document-term matrix),
    n_capitals (A-Z), n_points (code points) and n_symbols (bytes among
    ``symbols``, which are ASCII); and the dictionary (word, term)."""
    small_batches()
    recoded: dict[bytes, int] = {}
    while True:
        staged = _measured(rows, keep, symbols, recoded, bits, words_at_once)
        code = F.shiftrightunsigned(F.xxhash64("word"), 64 - bits)
        words = stage_table(staged.where(F.col("word").isNotNull()).select("word").distinct().select("word", code.alias("term")), "dictionary")
        if recoded:
            break
        twice = [r[0] for r in words.groupBy("term").agg(F.count("*").alias("n")).where("n > 1").select("term").limit(MAX_CLASHES + 1).collect()]
        if not twice:
            break
        clashing = [bytes(r[0]) for r in words.where(F.col("term").isin(twice)).select("word").limit(MAX_CLASHES + 1).collect()]
        if len(clashing) > MAX_CLASHES:
            raise ValueError(f"over {MAX_CLASHES} words clash in hashes of {bits} bits")
        recoded = {w: -1 - i for i, w in enumerate(sorted(clashing))}
    if recoded:
        own = rows.sparkSession.createDataFrame([(bytearray(w), t) for w, t in recoded.items()], "word binary, own bigint")
        words = words.join(F.broadcast(own), "word", "left").select("word", F.coalesce("own", "term").alias("term"))     # MAX_CLASHES rows at most
    return staged.where(F.col("word").isNull()).drop("word"), words


def failing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = 100,
            min_distinct: int = 80, max_capitals: int = 10, symbols: str = "#$%&*|") -> DataFrame:
    """part, fails (letters of the filters that a document fails), good, toxic
    and docs (their number): one row a combination that occurs.

    A: fewer than ``min_words`` words; B: distinct words under ``min_distinct``
    per cent of words; C: A-Z over ``max_capitals`` per cent of code points; D:
    holds one of ``symbols``; E: a row with a smaller id has the same text.
    Words are runs of anything but ASCII white space, in their own case. A null
    text is empty: it fails A and, like any other text, E. A null part is the
    empty string. A row with a null id never fails E and makes no other fail.
    Repeated rows count each; those with one id and text are no copies of each
    other. A label is held by an id if any of its label rows says so.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    body = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
                       text.alias("text"))
    counted, _ = measures(body, ["doc_id", "part", "digest"], symbols)
    own = F.concat(*[F.when(cond, x).otherwise("") for x, cond in (
        ("A", F.col("n_words") < min_words), ("B", 100 * F.col("n_distinct") < min_distinct * F.col("n_words")),
        ("C", 100 * F.col("n_capitals") > max_capitals * F.col("n_points")), ("D", F.col("n_symbols") > 0))])
    known = labels.groupBy(F.col("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                               F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    keys = ["digest", "part", "own", "good", "toxic"]
    rows = (counted.select("doc_id", "part", "digest", own.alias("own")).join(known, "doc_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}))
    by_id = rows.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"),
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    # A digest has as many rows here as there are parts and labels.
    first = F.min("least").over(Window.partitionBy("digest"))
    split = groups.withColumn("first", first).withColumn(
        "copies", F.col("named") - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0))
    both = split.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("own").alias("fails"), (F.col("n") - F.col("copies")).alias("docs")),
        F.struct(F.concat("own", F.lit("E")).alias("fails"), F.col("copies").alias("docs")))).alias("x"))
    return (both.select("part", "good", "toxic", "x.fails", "x.docs").groupBy("part", "fails", "good", "toxic")
            .agg(F.sum("docs").alias("docs")))


def audit(profile: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order of ``filters`` and step, from the rows of
    :func:`failing`: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (what the step's filter removes, over all orders).
    Parts without a document have no row; counts of nothing are 0."""
    orders = ["".join(p) for p in permutations(filters)]
    # A few rows a part, each met by every order and step.
    steps = (profile.withColumn("filter_order", F.explode(F.lit(orders)))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
             .withColumns({"letter": F.expr("substring(filter_order, step, 1)"), "before": F.expr("substring(filter_order, 1, step - 1)")})
             .withColumns({"now": F.expr("contains(fails, letter)"), "gone": F.expr("translate(fails, before, '') <> fails")}))

    def total(cond):
        return F.sum(F.when(cond, F.col("docs")).otherwise(0)).cast("long")

    now, gone = F.col("now"), F.col("gone")
    report = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~now & ~gone).alias("kept"), total(now & ~gone).alias("removed"), total(now & gone).alias("redundant"),
        total(F.col("fails") == F.col("letter")).alias("unique_fails"), total(now & ~gone & F.col("good")).alias("good_lost"),
        total(now & ~gone & F.col("toxic")).alias("toxic_lost"))
    return report.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


INTERACTIONS_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^{WHITE_CLASS}]+') AS w FROM documents),
flags AS (SELECT doc_id, part, concat(
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM docs),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
profile AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS docs
    FROM flags LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substring(filter_order, step, 1) AS letter, substring(filter_order, 1, step - 1) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
cases AS (SELECT part, filter_order, step, letter, good, toxic, docs, fails, contains(fails, letter) AS now,
    translate(fails, before, '') <> fails AS gone FROM profile, steps),
report AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT now AND NOT gone THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN now AND NOT gone THEN docs ELSE 0 END) AS removed, sum(CASE WHEN now AND gone THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN now AND NOT gone AND good THEN docs ELSE 0 END) AS good_lost,
    sum(CASE WHEN now AND NOT gone AND toxic THEN docs ELSE 0 END) AS toxic_lost FROM cases GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM report
"""
