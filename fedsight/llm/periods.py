"""Periodic runs of words by seeds that are extended along diagonals.

A run of period q and of max(6, 4 q) words or more matches itself at lag q over
max(6, 4 q) - q words at least. Lags are taken in classes [2^c, 2^(c+1)); each
class indexes the k-grams that such an overlap is certain to hold: k = 5 for
lag 1, k = 3 * 2^c above. k is at least one and a half times the lag, so inside
a run the *next* occurrence of a k-gram lies exactly one smallest period on
(anything nearer would give the k-gram a shorter period that divides q). Pairs
of consecutive occurrences are therefore all that is needed: as many as there
are words in each class, however often a gram repeats, and none of a multiple
of the smallest period. A pair seeds the diagonal of its lag and is extended
both ways; the furthest word covered on a lag so far passes over later seeds of
the same stretch. Grams are named exactly, by doubling, not by hashes.

A document's words never leave its task, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import by_value, small_batches

MIN_RUN, MIN_REPEATS = 6, 4

by_value(__name__)

Run = tuple[int, int, int]


def _joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Names of the grams that ``left`` at i and ``right`` at i + shift make; -1
    where a gram occurs once (nor does any longer one then)."""
    n = len(right) - shift
    out = np.full(max(n, 0), -1, dtype=np.int64)
    if n <= 0:
        return out
    a, b = left[:n], right[shift:shift + n]
    at = np.flatnonzero((a >= 0) & (b >= 0))
    if len(at) > 1:
        _, names, counts = np.unique(a[at] * (int(b.max()) + 1) + b[at], return_inverse=True, return_counts=True)
        out[at] = np.where(counts[names] > 1, names, -1)
    return out


def _seeds(names: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags in [lo, hi) and positions of consecutive occurrences, by lag, then position."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    same = names[at[1:]] == names[at[:-1]]
    lag, pos = (at[1:] - at[:-1])[same], at[:-1][same]
    keep = (lag >= lo) & (lag < hi)
    lag, pos = lag[keep], pos[keep]
    order = np.lexsort((pos, lag))
    return lag[order], pos[order]


def _reach(same_from: Callable[[int, int], np.ndarray], limit: int) -> int:
    """How many of the next ``limit`` comparisons hold without a break."""
    done, step = 0, 32
    while done < limit:
        part = same_from(done, min(done + step, limit))
        miss = part.argmin() if len(part) else 0
        if not part[miss]:
            return done + int(miss)
        done, step = done + len(part), step * 2
    return limit


def find_runs(w: np.ndarray) -> list[Run]:
    """All (start, length, period) of an array of word numbers, by start, then period."""
    n, found = len(w), []
    if n < MIN_RUN:
        return found

    def extend(lags: np.ndarray, at: np.ndarray, k: int) -> None:
        if not len(lags):
            return
        edges = np.flatnonzero(np.diff(lags)) + 1
        for group in np.split(np.arange(len(lags)), edges):
            q, pos = int(lags[group[0]]), at[group]
            i = covered = 0
            while i < len(pos):
                p = int(pos[i])
                b = p + k + _reach(lambda x, y: w[p + k + x:p + k + y] == w[p + k + q + x:p + k + q + y], n - q - p - k)
                a = p - _reach(lambda x, y: (w[p - y:p - x] == w[p + q - y:p + q - x])[::-1], p - covered)
                if b - a + q >= max(MIN_RUN, MIN_REPEATS * q):
                    found.append((a, b - a + q, q))
                covered = b                                        # matches up to here are known on this lag
                i += int(np.searchsorted(pos[i:], covered))

    one = _joined(w, np.zeros(n + 1, dtype=np.int64), 1)          # words that occur twice or more
    two = _joined(one, one, 1)
    three = _joined(two, one, 2)
    extend(*_seeds(_joined(three, two, 3), 1, 2), 5)
    names, k, lo = _joined(three, three, 3), 6, 2
    while (names >= 0).any():
        extend(*_seeds(names, lo, 2 * lo), k)
        names, k, lo = _joined(names, names, k), 2 * k, 2 * lo
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal words as equal ones."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in words), dtype=np.int64, count=len(words))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """Words, joined by a space, without those that a run repeats."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           edit: tuple[Column, Callable[[int, int], np.ndarray | None]] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and
    collapsed (the text's words, joined by one space, without the words that
    follow the first period of a run) of every row.

    Words are runs of anything but ASCII white space, numbered from 0. ``edit``
    is a long column and a function of its value and the number of words that
    gives the numbers of the words to put in their place (None: as they are); it
    is not asked for a null value or an empty text. Null, empty and blank texts
    have no run and an empty collapsed text. Rows keep their number, repeated
    ids and null ids included; other columns are not read. A text is handled
    whole in one task with memory in proportion to it.
    """
    key, change = edit or (F.lit(None), None)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), key.cast("long").alias("key"))
    # Python sees the id as it is, whatever its type.
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_runs, texts = [], []
            for text, k in zip(batch.column("text"), batch.column("key")):
                words = (text.as_py() or b"").split()
                order = change(k.as_py(), len(words)) if change and words and k.is_valid else None
                if order is not None:
                    words = [words[i] for i in order]
                runs = find_runs(numbered(words))
                all_runs.append(runs)
                texts.append(collapsed(words, runs))
            ends = np.cumsum([0, *map(len, all_runs)], dtype=np.int32)
            flat = np.array([r for runs in all_runs for r in runs], dtype=np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, spans),
                                              pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    small_batches()
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
