"""SentencePiece encoding and decoding with shared prefixes.

A text becomes marked words: a run of the space mark and what follows up to the next mark or character
without a piece (which is encoded as its bytes).  The distinct marked words of a batch are sorted, so they
are the leaves of a trie met depth-first: a word keeps the forward table of the prefix that it shares with
the word before and only its own characters are worked out.

The vocabulary is a byte-pair one: its segmentation follows merge ranks, and the best sum of piece scores
(a unigram Viterbi) would differ.  The forward table therefore holds, for each prefix, the last piece of the
prefix's segmentation: the piece t that ends there such that t may follow the last piece of the prefix
before t.  Exactly one piece qualifies, so the backward walk gives the library's own segmentation.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm import textkit

MARK = "▁"
_MODELS: dict[str, PieceCodec] = {}  # with the words they met
textkit.KEPT.append(_MODELS)


class PieceCodec:
    """``path``: a SentencePiece BPE model file with byte fallback; ``words``: most cached words."""

    def __init__(self, path: str, words: int = 150_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in special else p.encode() for i, p in enumerate(self.pieces)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.packed = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.limit, self.known = words, {}
        self.longest = max(map(len, self.ids))
        self.heads = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.goto: dict[tuple[str, str], str] = {}
        self.ends: dict[str, list[tuple[int, str]]] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        single = "".join(re.escape(p) for p in self.ids if len(p) == 1 and p != MARK)
        self.split = re.compile(f"{MARK}*[{single}]+|{MARK}+|.", re.S)

    def merges(self, text: str) -> list[str]:
        """The segmentation by its definition: the pair of least rank is merged first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == np.inf:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _ends(self, state: str) -> list[tuple[int, str]]:
        found = []
        for k in range(len(state)):
            t = state[k:]
            if t in self.ids:
                if t not in self.whole:
                    self.whole[t] = self.merges(t) == [t]
                if self.whole[t]:
                    found.append((len(t), t))
        self.ends[state] = found
        return found

    def _next(self, state: str, c: str) -> str:
        s = state + c
        while s not in self.heads:
            s = s[1:]
        self.goto[state, c] = s
        return s

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (native int32) of ``words`` (distinct, sorted, all of characters with a piece)."""
        goto, ends, follows, ids, out = self.goto, self.ends, self.follows, self.packed, {}
        state, last = [""], [""]  # by depth: automaton state, last piece of the prefix
        before = ""
        for word in words:
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del state[depth + 1 :], last[depth + 1 :]
            s = state[depth]
            for i in range(depth, len(word)):
                c = word[i]
                s = goto.get((s, c)) or self._next(s, c)
                state.append(s)
                options = ends.get(s)
                if options is None:
                    options = self._ends(s)
                for n, t in options:
                    p = last[i + 1 - n]
                    if not p:
                        last.append(t)
                        break
                    ok = follows.get((p, t))
                    if ok is None:
                        ok = follows[p, t] = self.merges(p + t) == [p, t]
                    if ok:
                        last.append(t)
                        break
                else:
                    break  # no piece may follow: a vocabulary whose merges don't nest
            before = word[: len(last) - 1]
            if len(last) <= len(word):
                out[word] = b"".join(ids[t] for t in self.merges(word))
                continue
            at, back = len(word), b""
            while at:
                t = last[at]
                back = ids[t] + back
                at -= len(t)
            out[word] = back
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split, known = self.split, self.known
        cut = [split.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = set().union(*cut)
        new = words - known.keys()
        if len(known) + len(new) > self.limit:  # words met again stay
            known = self.known = {w: known[w] for w in words & known.keys()}
            for cache in (self.follows, self.goto):
                if len(cache) > 2 * self.limit:
                    cache.clear()
        plain = []
        for w in new:
            if w[-1] in self.ids:
                plain.append(w)
            else:
                known[w] = np.array([self.byte_ids[b] for b in w.encode()], np.int32).tobytes()
        known.update(self.encode_words(sorted(plain)))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> PieceCodec:
    if path not in _MODELS:
        _MODELS[path] = PieceCodec(path)
    return _MODELS[path]


def _encoded(path: str, batch: pa.RecordBatch, limit: int = 2 << 20):
    """(lo, hi, texts, ids) over slices of a batch."""
    column = textkit.text_column(batch, "text")
    for lo, hi, _, _ in textkit.chunks(column, limit):
        texts = column.slice(lo, hi - lo).to_pylist()
        yield lo, hi, texts, codec(path).encode(texts)


def decoded(docs: DataFrame, path: str, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """``docs`` with the column ``text`` decoded from the ids (array<int>) in place of the one of that name; null ids give
    a null text, no ids the empty one.  Ids outside the vocabulary fail."""
    names = [c for c in docs.columns if c != text]
    rows = docs.select(*names)
    at = names.index(ids)

    def batches(batches):
        for batch in batches:
            own = codec(path)
            texts = [None if x is None else own.decode(np.array(x, np.int32)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(batches, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])).select(*docs.columns, *([] if text in docs.columns else [text]))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_sha256 (little-endian int32), round_trip: decoding gives the text again,
    with the space mark itself read as a space.  One row per input row, repeated and null ids too; null and empty
    texts have no pieces.  A text is encoded whole, in memory of about 100 bytes a byte of the longest one."""

    def batches(batches):
        for batch in batches:
            for lo, hi, texts, ids in _encoded(path, batch):
                own = codec(path)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]),
                        pa.array([own.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts)]),
                    ],
                    names=["doc_id", "n_bytes", "n_pieces", "ids_sha256", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, round_trip boolean")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with a column ``piece_ids`` array<int> more (one of that name before is replaced).  All rows and other
    columns stay; null and empty texts have no ids."""
    rows = docs.drop("piece_ids")

    def batches(batches):
        for batch in batches:
            for lo, hi, _, ids in _encoded(path, batch):
                part = batch.slice(lo, hi - lo)
                offs = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "piece_ids"])

    return rows.mapInArrow(batches, T.StructType([*rows.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))
