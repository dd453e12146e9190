"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed once, on the driver, and rebuilt as a tokenizer:
its normaliser (the precompiled character map and white-space rules), the
metaspace marker, and its pieces: unigram scores, or for a BPE model the merges
that its scores imply, each with byte fallback. The tokenizer travels to the
tasks as JSON (its size is the vocabulary's). If no piece reaches over a gap,
texts are cut at gaps and each word that a task meets for the first time is
encoded, in batches and with several threads, and a batch of texts gets its ids
from its distinct words' by one Arrow gather; other models encode whole texts.
Parity with the reference library is verified for every row: each newly met
word is encoded and decoded by both (whole texts for other models, and one text
in ``parity_every`` in any case), and a difference fails the job. Each text's ids
are decoded (where texts are cut at gaps by gathering the bytes of the pieces,
which the reference library's decoder confirms for each new word), and the
result is compared with the text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import by_value, small_batches

by_value(__name__)

MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: New words encoded at once, and encoded and verified as one text; characters of the words that a worker holds at most between batches.
WORDS_AT_ONCE, WORDS_TOGETHER, MOST_HELD = 5_000, 200, 4_000_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_WIDE = re.compile("(?<![^ ]) ")        # a space that begins a text or follows another
_BYTE = re.compile("<0x[0-9A-F]{2}>")


def read_bytes(spark, path: str) -> bytes:
    """The model file's content; local, or from any store that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Merges of a BPE model in the order of their results' scores: every split
    of a piece into two pieces is a way to make it."""
    usable = {p for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    rank = {p: i for i, (p, _, _) in enumerate(pieces)}
    order = sorted((p for p, _, kind in pieces if kind == NORMAL and len(p) > 1), key=lambda p: (-pieces[rank[p]][1], rank[p]))
    return [(p[:i], p[i:]) for p in order for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]


def rebuild(model: bytes) -> str:
    """JSON of the tokenizer that a SentencePiece model describes."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    m = pb.ModelProto()
    m.ParseFromString(model)
    pieces = [(p.piece, p.score, p.type) for p in m.pieces]
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    fallback = bool(m.trainer_spec.byte_fallback)
    spec = m.normalizer_spec
    if m.trainer_spec.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unk, byte_fallback=fallback)
    elif m.trainer_spec.model_type == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, merges_of(pieces), unk_token=pieces[unk][0], fuse_unk=True,
                          byte_fallback=fallback)
    else:
        raise ValueError(f"model type {m.trainer_spec.model_type} is neither unigram nor BPE")
    t = Tokenizer(core)
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape_whitespaces else " "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                  + ([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []))
    users = [AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER_DEFINED]
    if users:
        t.add_tokens(users)
    return t.to_str()


class _Engine:
    """A rebuilt tokenizer in a worker, with the words that it has met."""

    def __init__(self, text: str, threads: int, most_words: int = 200_000, reference=None):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        from tokenizers import Tokenizer
        self.tokenizer, self.most_words = Tokenizer.from_str(text), most_words
        # Ids of each word as bytes, by the word without the prefix; the words met again since words last went; characters held.
        self.words, self.again, self.held = {}, set(), 0
        spec, vocab = json.loads(text), self.tokenizer.get_vocab()
        steps = spec["normalizer"]["normalizers"]
        # Texts are cut at gaps if that can't part a piece, and if all that the normaliser does is to mark the gaps.
        self.by_word = (not any(MARK in p.lstrip(MARK) for p in vocab) and not spec["added_tokens"]
                        and all(n["type"] in ("Prepend", "Replace") and MARK in (n.get("prepend"), n.get("content")) for n in steps)
                        and any(n["type"] == "Replace" for n in steps))
        self.prefix = MARK if any(n["type"] == "Prepend" for n in steps) else ""
        self.by_word &= MARK in vocab
        if self.by_word:
            self.tokenizer.normalizer = None        # words come marked
        # Merges don't reach over a gap, so many words are one text; sums of unigram scores are rounded, so there each is a text.
        self.together = WORDS_TOGETHER if spec["model"]["type"] == "BPE" and self.prefix else 1
        self.threads, self.reference = threads, reference
        fallback = spec["model"].get("byte_fallback")
        raw = [bytes([int(n[3:5], 16)]) if fallback and _BYTE.fullmatch(n) else n.encode() for n in sorted(vocab, key=vocab.get)]
        self.sizes = np.array([len(b) for b in raw])
        self.table = pa.array(raw, pa.large_binary())       # piece bytes, gathered by id

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they decode to it."""
        if not self.by_word:
            ids = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.decode(ids)
            self.verify(texts, ids, back)
            return ids, [b == normal_form(x) for b, x in zip(back, texts)]
        cut = pc.split_pattern(pa.array([self.cut(x) or None for x in texts], pa.large_string()), " ")      # no text: no words
        coded, n_words = cut.flatten().dictionary_encode(), pc.fill_null(pc.list_value_length(cut), 0).to_numpy()
        here = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, here))
        self.again.update(compress(here, found))
        if len(self.words) > self.most_words or self.held > MOST_HELD:      # words met again stay
            self.words, self.again = {w: self.words[w] for w in self.again}, set()
            self.held = sum(map(len, self.words))
        new = [w for w, i in zip(here, found) if i is None]
        for i in range(0, len(new), WORDS_AT_ONCE):
            self._meet(new[i:i + WORDS_AT_ONCE])
        found = [self.words[w] if i is None else i for w, i in zip(here, found)]
        reach = np.cumsum([0, *map(len, found)]) // 4
        flat = pa.LargeListArray.from_arrays(reach, np.frombuffer(b"".join(found), dtype=np.int32)).take(coded.indices).flatten().to_numpy()
        ends = np.append(0, np.cumsum(np.diff(reach)[coded.indices.to_numpy()]))[np.cumsum(n_words, dtype=int)].tolist()
        ids = [flat[a:b] for a, b in zip([0, *ends], ends)]
        return ids, [b == normal_form(x) for b, x in zip(self.decode(ids), texts)]

    def cut(self, text: str) -> str:
        """The text's words with a space between two, each with the gap before it
        marked and without the prefix. A last gap is a word."""
        text = text.replace(MARK, " ")
        if self.prefix:
            return _WIDE.sub(MARK, text) if "  " in text or text[:1] == " " else text
        return " ".join(_WORD.findall(text.replace(" ", MARK)))

    def verify(self, texts: list[str], ids: list[np.ndarray], back: list[str]) -> None:
        """Compare with the reference library, if there is one."""
        if self.reference is None or not texts:
            return
        for x, i, b, want, text in zip(texts, ids, back, self.reference.encode(texts, out_type="numpy", num_threads=self.threads),
                                       self.reference.decode(ids, num_threads=self.threads)):
            if want.tobytes() != i.tobytes() or text != b:
                raise ValueError(f"pieces differ from the reference library's for the text {x[:200]!r}")

    def _meet(self, new: list[str]) -> None:
        """Encode new words, as many to a text as may be, find each one's ids by the pieces' lengths in bytes, and verify them."""
        if self.together > 1:       # words that end in a gap come last in a text, so each is a text of its own
            full, gaps = [w for w in new if w and not w.endswith(MARK)], [w for w in new if not w or w.endswith(MARK)]
            groups = [full[i:i + self.together] for i in range(0, len(full), self.together)] + [[w] for w in gaps]
        else:
            full, gaps, groups = new, [], [[w] for w in new]
        marked = [self.prefix + self.prefix.join(g) for g in groups]
        ids = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
        flat, words = np.concatenate(ids), full + gaps
        reach, ends = np.cumsum(self.sizes[flat]), np.cumsum([len(self.prefix.encode()) + len(w.encode()) for w in words])
        if b"".join(self._bytes(ids)) == "".join(marked).encode() and np.isin(ends, reach).all():
            cuts, raw = (4 * np.searchsorted(reach, ends, side="right")).tolist(), flat.tobytes()
            self.words.update(zip(words, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        else:
            for w, e in zip(words, self.tokenizer.encode_batch_fast([self.prefix + w for w in words], add_special_tokens=False)):
                self.words[w] = np.array(e.ids, dtype=np.int32).tobytes()
        self.held += sum(map(len, new))
        # The prefix alone is no text's word but the last gap's, the mark's own piece.
        self._confirm([g for g in groups if g != [""]])
        if self.reference is not None and "" in gaps + full and self.words[""] != np.array([self.reference.piece_to_id(MARK)], dtype=np.int32).tobytes():
            raise ValueError("pieces differ from the reference library's for a gap")

    def _confirm(self, groups: list[list[str]]) -> None:
        """Verify met words, each group as the text that is cut to its words."""
        if self.reference is None:
            return
        ids = [np.frombuffer(b"".join(map(self.words.__getitem__, g)), dtype=np.int32) for g in groups]
        try:
            self.verify([self.prefix.join(g).replace(MARK, " ") for g in groups], ids, self.decode(ids))
        except ValueError:
            if any(len(g) > 1 for g in groups):
                self._confirm([[w] for g in groups for w in g])        # names the word
            raise

    def _bytes(self, ids: list) -> list[bytes]:
        """The pieces' bytes of each text, gathered for all texts at once."""
        ends, flat = np.cumsum([0, *map(len, ids)]), np.concatenate([np.empty(0, dtype=np.int32), *(np.asarray(i, dtype=np.int32) for i in ids)])
        pieces = self.table.take(pa.array(flat))
        return pc.binary_join(pa.LargeListArray.from_arrays(ends, pieces), pa.scalar(b"", pa.large_binary())).to_pylist()

    def decode(self, ids: list) -> list[str]:
        """Texts of ids that this engine made. Where texts are cut at gaps, the
        bytes of all texts' pieces are gathered at once; the reference library's
        decoder confirms that for each new word (see :meth:`_meet`)."""
        if not self.by_word:
            return self.library_decode([np.asarray(i, dtype=np.int32).tolist() for i in ids])
        return [b.decode("utf-8", "replace").replace(MARK, " ")[len(self.prefix):] for b in self._bytes(ids)]

    def library_decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of any ids."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _give_back() -> None:
    """Return freed memory to the machine: workers live on for other tasks."""
    import ctypes
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library
        pass


def normal_form(text: str) -> str:
    """What a text decodes to, for models that keep white space as it is: the
    text with metaspace marks as spaces."""
    return text.replace(MARK, " ")


class Codec:
    """Encoder and decoder of one SentencePiece model for use in Spark."""

    def __init__(self, spark, path: str = DEFAULT_MODEL, threads: int = 2, parity_every: int = 50, batch_chars: int = 1_000_000):
        model = read_bytes(spark, path)
        self.json, self.model = spark.sparkContext.broadcast(rebuild(model)), spark.sparkContext.broadcast(model)   # as large as the vocabulary
        self.threads, self.parity_every, self.batch_chars = threads, parity_every, batch_chars

    def encode(self, text: Column) -> Column:
        """Struct of ids (array of int) and same: whether decoding the ids gives
        the text back (true also for a null text). Null and empty texts have no ids."""
        table, model, threads, every, most = self.json, self.model, self.threads, self.parity_every, self.batch_chars

        def run(batches):
            import gc
            import sentencepiece
            gc.collect()
            _give_back()                                        # what other tasks left in this worker
            sp, seen = sentencepiece.SentencePieceProcessor(model_proto=model.value), 0
            t = _Engine(table.value, threads, reference=sp)
            for texts in batches:
                for part in _parts(texts.fillna(""), most):     # small results: a batch's ids are never held together
                    got, kept = t.encode(part)
                    for x, i in zip(part, got):
                        if seen % every == 0:
                            t.verify([x], [i], t.library_decode([i.tolist()]))
                        seen += 1
                    yield pd.DataFrame({"ids": got, "same": kept})
                    del got, kept
                    _give_back()
            del t, sp
            gc.collect()
            _give_back()

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, "ids array<int>, same boolean")(text)

    def decode(self, ids: Column) -> Column:
        """Text of an array of ids (null ids: null)."""
        table, threads = self.json, self.threads

        def run(batches):
            t = _Engine(table.value, threads)
            for s in batches:
                texts = t.library_decode([[] if x is None else [int(i) for i in x] for x in s])
                yield pd.Series([None if x is None else y for x, y in zip(s, texts)], dtype="object")

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "string")(ids)


def _parts(texts: pd.Series, most: int):
    """Runs of texts of about ``most`` characters together, at least one text each."""
    part, n = [], 0
    for x in texts:
        if part and n + len(x) > most:
            yield part
            part, n = [], 0
        part.append(x)
        n += len(x)
    if part:
        yield part


def encode_documents(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_pieces and same of every row (repeated rows and null ids
    included; null and empty texts have no pieces). Other columns are not read."""
    small_batches()
    return docs.select(F.col(id_col).alias("doc_id"), codec.encode(F.col(text_col)).alias("e")).select(
        "doc_id", F.col("e.ids").alias("ids"), F.size("e.ids").cast("long").alias("n_pieces"), F.col("e.same").alias("same"))
