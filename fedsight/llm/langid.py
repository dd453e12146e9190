"""Language identification in two steps: family, then close relatives.

A text becomes a hashed profile of its letter n-grams (1 to 3, lower-cased,
anything else is a gap). A logistic model predicts the language family from
it; within the family, one-versus-one linear support vector machines vote.
Models are fitted by Spark ML on a bounded sample; prediction is a vectorised
pass over whole texts with the coefficients in the closure.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.functions.rank import top_k_per_group
from fedsight.llm.common import by_value, small_batches

by_value(__name__)

#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"],
    "uralic": ["fi", "et", "hu"], "baltic": ["lt", "lv"], "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "pa", "gu", "ur"], "semitic": ["ar", "he", "mt"],
}
FAMILY_OF = {code: f for f, codes in FAMILIES.items() for code in codes}
DIM = 2048
#: Characters handled at a time, which bounds a task's memory on very long texts.
BLOCK = 1 << 20

_LETTERS = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS


def profile(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Square roots of hashed n-gram counts, of unit length; None without a letter."""
    is_letter = _letters()
    t = (text or "").lower()
    counts, any_letter = np.zeros(dim), False
    tail = np.array([32], dtype=np.uint64)      # the last codes of what came before; texts begin and end with a gap
    for at in range(0, len(t) + 1, BLOCK):
        c = np.frombuffer(t[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        keep = is_letter[c]
        any_letter = any_letter or bool(keep.any())
        c = np.where(keep, c, 32).astype(np.uint64)
        if at + BLOCK > len(t):
            c = np.append(c, np.uint64(32))
        n_old = len(tail)
        c = np.concatenate((tail, c))
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]     # one gap between words
        h2 = c[:-1] * np.uint64(0x9E3779B1) + c[1:]
        h3 = h2[:-1] * np.uint64(0x85EBCA77) + c[2:]
        for n, h in ((1, c[n_old:]), (2, h2[n_old - 1:]), (3, h3[max(0, n_old - 2):])):
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % dim, minlength=dim)
        tail = c[-2:]
    if not any_letter:
        return None
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


@dataclass
class Model:
    """``families``: languages of each; ``family_*``: coefficients (one row a
    family, in order); ``pairs``: coefficients of a - b for each pair of relatives."""
    families: dict[str, list[str]]
    family_w: np.ndarray | None = None
    family_b: np.ndarray | None = None
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)
    dim: int = DIM

    def predict(self, text: str | None) -> tuple[str, float]:
        x = profile(text, self.dim)
        if x is None or not self.families:
            return "und", 0.0
        names = list(self.families)
        if len(names) == 1:
            i, sure = 0, 1.0
        else:
            z = self.family_w @ x + self.family_b
            z = np.exp(z - z.max())
            i, sure = int(z.argmax()), float(z.max() / z.sum())
        langs = self.families[names[i]]
        if len(langs) == 1:
            return langs[0], sure
        wins = dict.fromkeys(langs, 0.0)
        part = dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            w, bias = self.pairs[a, b]
            p = 1 / (1 + np.exp(-np.clip(4 * (w @ x + bias), -50, 50)))
            wins[a if p >= 0.5 else b] += 1
            part[a], part[b] = part[a] + p, part[b] + 1 - p
        best = max(langs, key=lambda g: (wins[g], part[g], g))
        return best, float(sure * part[best] / (len(langs) - 1))


def predict(text: Column, model: Model) -> Column:
    """Struct of lang_pred and score (0 to 1) of a text: the product of the
    family's probability and the mean of the winner's pairwise ones. ``und`` and
    0 if the text is null or has no letter, or the model knows no language."""
    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])
    small_batches()
    return run(text)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500,
        max_rows: int = 32_000, dim: int = DIM) -> Model:
    """Model from labelled texts. Every language is learned; the sample is
    bounded by rows: of each language the ``per_lang`` rows whose id has the
    smallest hash, or fewer (one at least) if all languages together would have
    more than ``max_rows``. Rows with a null language, id or text, and texts
    without a letter, teach nothing. No usable row: a model without languages."""
    small_batches()
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = usable.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    per_lang = max(1, min(per_lang, max_rows // max(1, rows.select("lang").distinct().count())))
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) + F.lit(0.5)) / F.lit(float(1 << 31))
    ids = (top_k_per_group(rows.withColumn("draw", draw), ["lang"], "draw", ["doc_id"], per_lang)
           .select("doc_id").distinct())
    vector = F.pandas_udf(lambda s: pd.Series([None if (x := profile(t, dim)) is None else x for t in s]), "array<double>")
    sample = (labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
              .select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
              .join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text").repartition(4)    # max_rows ids, or one a language, at most
              .select("lang", vector("text").alias("x")).cache())
    # Filtered after the cache only: below it, the filter would be pushed under the join and profile every document.
    taught = sample.where(F.col("x").isNotNull()).select("lang", array_to_vector("x").alias("x"))
    try:
        found = sorted(r["lang"] for r in taught.select("lang").distinct().collect())
        families: dict[str, list[str]] = {}
        for g in found:
            families.setdefault(FAMILY_OF.get(g, g), []).append(g)
        model = Model(dict(sorted(families.items())), dim=dim)
        names = list(model.families)
        if len(names) > 1:
            number = F.create_map(*[F.lit(v) for i, n in enumerate(names) for g in model.families[n] for v in (g, float(i))])
            lr = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-4, maxIter=30).fit(
                taught.select("x", number[F.col("lang")].alias("y")))
            model.family_w, model.family_b = lr.coefficientMatrix.toArray(), np.array(lr.interceptVector.toArray())
        for langs_ in model.families.values():
            for a, b in combinations(langs_, 2):
                svc = LinearSVC(featuresCol="x", labelCol="y", regParam=1e-3, maxIter=12, tol=1e-3).fit(
                    taught.where(F.col("lang").isin(a, b)).select("x", (F.col("lang") == a).cast("double").alias("y")))
                model.pairs[a, b] = (svc.coefficients.toArray(), float(svc.intercept))
        return model
    finally:
        sample.unpersist()


def known(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose language is told with ``min_score`` or more, all
    columns kept; texts that are null or have no letter go."""
    def told(texts: pd.Series) -> pd.Series:
        found = (model.predict(t) for t in texts)
        return pd.Series([lang != "und" and score >= min_score for lang, score in found], dtype="bool")
    small_batches()
    return docs.where(F.pandas_udf(told, "boolean")(F.col(text_col)))
