"""Repeated passages against brute force: repeated and null ids, crowded seeds, both covers."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from meridia.llm import piece_codec, suffix_dedup
from meridia.llm.suffix_dedup import RESIDUES, SuffixDedup

SCHEMA = "doc_id long, text string, twin long, blob string, __doc long, n_removed int"


def brute(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row, sorted."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1) if i is not None else ():
            least[b[s : s + length]] = min(i, least.get(b[s : s + length], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1) if i is not None else ():
            if least[b[s : s + length]] < i:
                mark[s : s + length] = b"\x01" * length
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((i, len(b), sum(mark), len(re.findall(b"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    phrase, passage, rows = "a phrase of thirty bytes here!", text(30), []
    for i in range(70):
        t = text(rnd.randint(0, 40))
        kind = rnd.random()
        if kind < 0.5:  # one phrase, and often more around it
            near = rnd.choice(["", " and some more of the same after it", " or another way to go on"])
            t += rnd.choice(["", "the words before it are "]) + phrase + near + text(5)
        elif kind < 0.7:
            t += passage[rnd.randint(0, 40) :] + text(3)
        elif kind < 0.8 and rows:
            t = rnd.choice(rows)[1] or ""
        rows.append((rnd.randint(-5, 40), t))  # ids repeat
    rows += [rows[3], rows[3], (7, None), (8, ""), (None, passage), (None, None), (50, passage * 40), (51, "x" * 5000), (52, "x" * 60)]
    return rows


@pytest.mark.parametrize("options", [{}, {"crowd": 1, "block": 2}, {"bucket_bytes": 300, "crowd": 2}, {"sampling": "residues"}, {"sampling": "residues", "block": 3}])
def test_against_brute_force(spark, options):
    rows = rows_of(len(options) + 5)
    docs = spark.createDataFrame([(*r, 1, "b", 2, 3) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in SuffixDedup(**options).digest(docs).collect()), key=str)
    assert got == brute(rows)


def test_two_rows_of_one_id(spark):
    a = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(1, a), (2, a + " tail"), (2, "short"), (2, None), (2, "head " + a)]
    docs = spark.createDataFrame([(*r, 1, "b", 2, 3) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in SuffixDedup().digest(docs).collect()), key=str) == brute(rows)
    out = SuffixDedup().rewrite(docs)
    assert out.schema == docs.schema
    assert sorted((r["doc_id"], r["text"] or "", r["__doc"], r["blob"]) for r in out.collect()) == sorted([(1, a, 2, "b"), (2, " tail", 2, "b"), (2, "short", 2, "b"), (2, "", 2, "b"), (2, "head ", 2, "b")])


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(suffix_dedup, "sized", lambda df: df)
    rows = rows_of(11)
    docs = spark.createDataFrame([(*r, 1, "b", 2, 3) for r in rows], SCHEMA).repartition(2)
    assert sorted((tuple(r) for r in SuffixDedup(block=3).digest(docs).collect()), key=str) == brute(rows)


def test_residues_are_a_cover():
    at = np.flatnonzero(RESIDUES)
    assert {(a - b) % 31 for a in at for b in at} == set(range(31))


def test_texts_are_cut_and_leave_in_parts():
    """A batch of long texts is held once: what has been cut leaves before the rest is."""
    rnd = random.Random(3)
    texts = [None, "", *("".join(rnd.choices("abé ", k=4000)) for _ in range(2500)), "x" * 5_000_000, "é" * 30]
    spans = [None if i % 3 == 0 or not t else np.array([[3, 60], [100, 1 << 40]] if i % 2 else [[1, 2]], np.int64).tobytes() for i, t in enumerate(texts)]
    fields = {"doc_id": pa.array(range(len(texts))), "text": pa.array(texts), "blob": pa.array(spans, pa.binary())}
    out = list(SuffixDedup._cuts(1)(iter([pa.RecordBatch.from_pydict(fields)])))
    assert all(b.schema.names == ["doc_id", "text"] for b in out)
    assert max(b.column(1).nbytes for b in out if len(b) > 1) < 2 << 20 and len(out) > 5
    want = []
    for t, s in zip(texts, spans):
        raw = (t or "").encode()
        for a, b in reversed(np.frombuffer(s or b"", np.int64).reshape(-1, 2).tolist()):
            raw = raw[:a] + raw[b:]
        want.append(t if t is None else raw.decode("utf-8", "ignore"))
    got = pa.Table.from_batches(out)
    assert got.column("text").to_pylist() == want and got.column("doc_id").to_pylist() == list(range(len(texts)))


def test_workers_drop_the_codec():
    """The words that an encoder met don't stay beside the samples."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert piece_codec.codec(path).encode(["some words"]) and piece_codec.codec(path) is piece_codec.codec(path)
    assert not list(SuffixDedup()._samples(4)(iter([]))) and not piece_codec._MODELS
    assert piece_codec.codec(path).decode(piece_codec.codec(path).encode(["some words"])[0]) == "some words"


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert SuffixDedup().digest(nothing).count() == 0 and SuffixDedup().rewrite(nothing).schema == nothing.schema
