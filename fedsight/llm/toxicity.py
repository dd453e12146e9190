"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs and accents to plain letters,
digits and signs inside words to the letters they stand for. The lexicon holds
word beginnings (a whole word or the stem of a family of words) with weights;
one automaton finds all of them and all exception phrases in one pass over a
text; a hit inside an exception phrase does not count. The weights of the hits,
normalised by the text's length, give the score by a fitted logistic curve.

The lexicon is learned from labelled texts: Spark counts, over distinct texts,
in how many toxic and clean ones each word beginning occurs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import by_value, small_batches

by_value(__name__)

#: Letters of other scripts, and Latin ones without a decomposition, and the plain letters they look like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ѡ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss",
}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "pond scum", "soap scum", "sore loser"]

#: Log-likelihood ratio from which a word's share in toxic texts is no accident.
LEAST_RATIO = 30.0

_GLYPHS = str.maketrans({**HOMOGLYPHS, **dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad", None)})
_LEET = str.maketrans(SUBSTITUTES)
#: A token with a digit or sign; the start is anchored and the prefix possessive, so a long token is read once.
_MIXED = re.compile(r"(?<!\S)[^\s0-9@$!]*+[0-9@$!]\S*")
_EDGE = ".,;:!?'\"()[]{}-–—…"
_GAPS = re.compile(r"[\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")


def _unmix(m: re.Match) -> str:
    word = m.group()
    core = word.strip(_EDGE)
    return word.replace(core, core.translate(_LEET), 1) if any(c.isalpha() for c in core) else word


def folded(text: str | None) -> str:
    """Folded words, each with one space before it, and one space at the end."""
    t = (text or "").lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t.translate(_GLYPHS))).translate(_GLYPHS)
    t = _GAPS.sub(" ", _MIXED.sub(_unmix, t)).strip()
    return f" {t} " if t else " "


@dataclass
class Lexicon:
    """``terms``: weights of word beginnings (of whole words, if they end in a
    space); ``phrases``: exceptions (whole
    words); ``curve``: intercept and factors of the two features."""
    terms: dict[str, float]
    phrases: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(" " + t, (len(t) + 1, float(w)))
        for p in self.phrases:
            p = folded(p)
            if len(p) > 2:
                a.add_word(p, (len(p), None))
        if not len(a):
            return None
        a.make_automaton()
        return a


def match(automaton: ahocorasick.Automaton | None, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the hits in a folded text. Of the beginnings that
    match one word the longest counts; hits inside an exception phrase do not."""
    if automaton is None:
        return []
    hits: dict[int, tuple[int, float]] = {}
    spans = []
    for end, (n, w) in automaton.iter(text):
        start = end - n + 1
        if w is None:
            spans.append((start, end))
        elif start not in hits or end > hits[start][0]:
            hits[start] = (end, w)
    spans.sort()
    out, i, reach = [], 0, -1
    for s, (e, w) in sorted(hits.items()):
        while i < len(spans) and spans[i][0] <= s:
            reach = max(reach, spans[i][1])
            i += 1
        if e > reach:
            out.append((s, e, w))
    return out


def features(hits: list[tuple[int, int, float]], n_words: int) -> tuple[float, float]:
    """Log of the hits' added odds (so that many weak hits do not outweigh a
    strong one), and log of the length that normalises it."""
    return math.log1p(sum(math.expm1(min(w, 20.0)) for _, _, w in hits)), math.log1p(n_words)


def _score_series(lexicon: Lexicon):
    built: list = []    # the automaton, once a task

    def score(texts: pd.Series) -> pd.DataFrame:
        if not built:
            built.append(lexicon.automaton())
        a = built[0]
        b, c, d = lexicon.curve
        rows = []
        for t in texts:
            f = folded(t)
            hits = match(a, f)
            x, y = features(hits, f.count(" ") - 1)
            z = b + c * x + d * y if hits else min(b, -4.0)
            rows.append((1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), len(hits)))
        return pd.DataFrame(rows, columns=["score", "n_hits"])
    return score


def score(text: Column, lexicon: Lexicon) -> Column:
    """Struct of score (0 to 1, higher: more toxic) and n_hits of a text. Null,
    empty and word-less texts have no hit and the score of a text without hits."""
    small_batches()
    return F.pandas_udf(_score_series(lexicon), "score double, n_hits int")(text)


def _beginnings(shortest: int, longest: int):
    """Word beginnings and whole words (ending in a space) of a batch of labelled texts (``p``), each once a text."""
    def rows(batches):
        for whole in batches:
            for at in range(0, len(whole), 100):    # a text has thousands of beginnings
                b = whole.iloc[at:at + 100]
                ps, ys = [], []
                for t, y in zip(b["text"], b["toxic"]):
                    seen = set()
                    for w in set(folded(t).split()):
                        seen.update(w[:k] for k in range(shortest, min(len(w), longest) + 1))
                        seen.add(w[:longest] + " " * (len(w) <= longest))
                    ps.extend(seen)
                    ys.extend([y] * len(seen))
                yield pd.DataFrame({"p": ps, "toxic": np.asarray(ys, dtype="int64")})
    return rows


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = 20_000, shortest: int = 3, longest: int = 14, min_share: float = 0.01, min_texts: int = 4,
          min_lift: float = 4.0) -> Lexicon:
    """Lexicon and curve from labelled texts.

    A bounded sample of labels teaches: about ``max_rows``, by a threshold on
    the hash of the id, and of equal texts one. A word beginning or whole word
    is a term when it occurs in ``min_share`` of the toxic texts (``min_texts`` at least),
    ``min_precision`` of the texts that hold it are toxic, and the
    log-likelihood ratio is clear; of beginnings of one word that say the same,
    the longest stays. A term's weight is its log odds. Words with a term that
    occur only in clean texts become exceptions. Rows with a null label, id or
    text are left out; a text with two labels counts as toxic. Without toxic
    texts the lexicon is empty.
    """
    small_batches()
    named = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
             .agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    share = min(1.0, max_rows / max(1, named.count()))
    sample = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = (docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(sample), "doc_id")        # max_rows rows of two numbers
            .groupBy(F.sha2("text", 256).alias("key")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
            .select("text", "toxic").cache())
    try:
        n = dict(rows.groupBy("toxic").count().collect())
        n_tox, n_clean = n.get(1, 0), n.get(0, 0)
        if not n_tox:
            return Lexicon({}, curve=(-4.0, 0.0, 0.0))
        least = max(min_texts, math.ceil(min_share * n_tox))
        counts = (rows.mapInPandas(_beginnings(shortest, longest), "p string, toxic long").groupBy("p")
                  .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
        # Then, of those, what stands in many places, and not in copies of one: a word's places are the two words before it.
        # What passes is bounded by the number of beginnings that min_share of the toxic texts of the sample can hold.
        good = {r["p"]: (r["t"], r["c"]) for r in counts.where(
            (F.col("t") >= least) & (F.col("t") / n_tox >= min_lift * F.col("c") / max(1, n_clean))).collect()}
        rated = {p: (tc, r) for p, tc in good.items() if (r := _ratio(*tc, n_tox, n_clean)) >= LEAST_RATIO}
        places = _places(rows, rated)
        terms = _best({p: x for p, x in rated.items() if places.get(p, 0) >= max(min_texts, 0.2 * x[0][0])})
        weights = {p: round(math.log((t + 0.5) / (n_tox + 1)) - math.log((c + 0.5) / (n_clean + 1)), 6) for p, (t, c) in terms.items()}
        lexicon = Lexicon(weights, EXCEPTIONS + _harmless(rows, weights))
        lexicon.curve = _fit(rows, lexicon)
        return lexicon
    finally:
        rows.unpersist()


def _ratio(t: int, c: int, n_tox: int, n_clean: int) -> float:
    """Dunning's log-likelihood ratio of a word's counts in toxic and clean texts."""
    def part(k, n, share):
        return (k * math.log(k / (n * share)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - share))) if k < n and share < 1 else 0.0)
    share = (t + c) / (n_tox + n_clean)
    return 2 * (part(t, n_tox, share) + part(c, n_clean, share))


def _places(rows: DataFrame, words: dict) -> dict[str, int]:
    """In how many different places (the two folded words before) each word beginning stands in toxic texts."""
    wanted = frozenset(words)
    longest = max(map(len, wanted), default=0)

    def found(batches):
        for b in batches:
            out = set()
            for t in b["text"][b["toxic"] == 1]:
                w = ["", "", *folded(t).split()]
                for i in range(2, len(w)):
                    for k in range(1, min(len(w[i]) + 1, longest) + 1):
                        p = (w[i] + " ")[:k]
                        if p in wanted:
                            out.add((p, f"{w[i - 2]} {w[i - 1]}"))
            yield pd.DataFrame(sorted(out), columns=["p", "place"])
    if not wanted:
        return {}
    return dict(rows.mapInPandas(found, "p string, place string").distinct().groupBy("p").count().collect())


def _best(good: dict[str, tuple[tuple[int, int], float]]) -> dict[str, tuple[int, int]]:
    """Terms by their ratio, largest first (of equal ones the longer, but a
    beginning before its whole word), without beginnings or extensions of a kept one."""
    kept: dict[str, tuple[int, int]] = {}
    heads: set[str] = set()     # every beginning of a kept term
    for p in sorted(good, key=lambda p: (-round(good[p][1], 6), p[-1] == " ", -len(p), p)):
        if p not in heads and not any(p[:k] in kept for k in range(1, len(p))):
            kept[p] = good[p][0]
            heads.update(p[:k] for k in range(1, len(p)))
    return kept


def _harmless(rows: DataFrame, weights: dict[str, float], at_least: int = 2) -> list[str]:
    """Words that hold a term but occur in clean texts only."""
    heads = sorted((w for w in weights if not w.endswith(" ")), key=len)
    if not heads:
        return []
    pattern = re.compile(" ((?:" + "|".join(map(re.escape, heads)) + ")[^ ]*)")

    def words(batches):
        for b in batches:
            out = [(w, y) for t, y in zip(b["text"], b["toxic"]) for w in set(pattern.findall(folded(t)))]
            yield pd.DataFrame(out, columns=["w", "toxic"]).astype({"toxic": "int64"})
    n = rows.mapInPandas(words, "w string, toxic long").groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    return sorted(r["w"] for r in n.where((F.col("t") == 0) & (F.col("n") >= at_least)).collect())


def _fit(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic curve over the two features, fitted to the texts that have a hit
    (a text without one scores low anyway), with light shrinkage."""
    def feats(batches):
        a = lexicon.automaton()
        for b in batches:
            out = []
            for t, y in zip(b["text"], b["toxic"]):
                f = folded(t)
                h = match(a, f)
                if h:
                    out.append((*features(h, f.count(" ") - 1), int(y)))
            yield pd.DataFrame(out, columns=["x", "y", "label"]).astype({"x": "float64", "y": "float64", "label": "int64"})
    data = rows.mapInPandas(feats, "x double, y double, label long").toPandas()   # three numbers for each sampled row
    X = np.column_stack([np.ones(len(data)), data["x"], data["y"]])
    y = data["label"].to_numpy(float)
    if not len(y):
        return -4.0, 0.0, 0.0
    start, pull = np.array([-4.0, 1.0, 0.0]), 0.1       # shrinks towards a curve that rises with the hits

    def loss(w):
        z = X @ w
        return float((np.logaddexp(0, z) - y * z).sum() + pull * ((w - start) ** 2).sum() / 2)
    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -50, 50)))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + pull * np.eye(3), X.T @ (y - p) - pull * (w - start))
        size, at = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > at:
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(0.0, w[1])), float(min(0.0, w[2]))


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text scores below the threshold, all columns kept."""
    return docs.where(score(F.col(text_col), lexicon)["score"] < threshold)
