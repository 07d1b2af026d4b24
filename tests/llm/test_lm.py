"""Stupid backoff against brute force: each text by the model of all others."""

import collections
import math
import random
import re

import pytest

from meridia.llm.lm_scoring import StupidBackoff, pack, unpack

import numpy as np

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, bucket int, kind string, log_score double"


def brute(rows, order=3, alpha=0.4, least=1):
    """{doc_id: (n_words, n_backoff, n_unigram, log_score)}."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    grams = lambda v, n: collections.Counter(zip(*(v[k:] for k in range(n))))
    every = [sum((grams(v, n) for _, v in texts), collections.Counter()) for n in (1, 2, 3)]
    total = sum(every[0].values())
    out = {}
    for i, v in texts:
        if i is None:
            continue
        own = [grams(v, n) for n in (1, 2, 3)]
        c = lambda *g: every[len(g) - 1][g] - own[len(g) - 1][g]
        score, back, single = 0.0, 0, 0
        for k, w in enumerate(v):
            word = every[0][w,] / total
            if k == 0:
                score += math.log(word)
                continue
            pair = c(v[k - 1], w)
            if k > 1 and order == 3 and c(v[k - 2], v[k - 1], w) >= least:
                score += math.log(c(v[k - 2], v[k - 1], w) / c(v[k - 2], v[k - 1]))
                continue
            drop = k > 1 and order == 3
            back += drop or pair < least
            single += pair < least
            score += math.log(alpha) * (drop + (pair < least)) + math.log(word if pair < least else pair / every[0][v[k - 1],])
        had = out.get(i, (0, 0, 0, 0.0))
        out[i] = tuple(a + b for a, b in zip(had, (len(v), back, single, score)))
    return out


def rows_of(seed, n=90):
    rnd = random.Random(seed)
    vocab = ["the", "of", "a", "run", "délta", "😀"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(vocab[: rnd.choice([8, 60])]) for _ in range(rnd.choice([1, 2, 3, 40, 120]))) for _ in range(n)]
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)] + [(900 + i, texts[i]) for i in range(5)]
    rows += [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "same same " * 400), (None, texts[3]), (None, None), (10, texts[4]), (10, texts[5]), (10, texts[5])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"frequent": 5}, {"frequent": 0, "gram_rows": 50, "slice_bytes": 500}, {"order": 2, "frequent": 10}, {"least": 2, "alpha": 0.3}])
def test_against_brute_force(spark, options):
    rows = rows_of(4)
    docs = spark.createDataFrame([(*r, 1, "k", 0.0) for r in rows], SCHEMA).repartition(3)
    want = brute(rows, **{k: v for k, v in options.items() if k in ("order", "alpha", "least")})
    got = StupidBackoff(**options).score(docs).collect()
    assert len(got) == len(want) == len({r["doc_id"] for r in got})
    for r in got:
        n, back, single, score = want[r["doc_id"]]
        assert (r["n_words"], r["n_backoff"], r["n_unigram"]) == (n, back, single)
        assert r["log_score"] == pytest.approx(score, rel=1e-6, abs=1e-6)
        assert r["mean_log_score"] == (pytest.approx(score / n, rel=1e-6, abs=1e-6) if n else None)


def test_partition_read_again(monkeypatch):
    from meridia.llm import lm_scoring

    rows = rows_of(6, 40)
    op = StupidBackoff()
    top = lm_scoring._Top(np.arange(5, dtype=np.uint64) << np.uint64(60), np.arange(5) + 1)
    assert top.code(top.hashes).tolist() == [0, 1, 2, 3, 4] and top.code(np.array([7], np.uint64)).tolist() == [lm_scoring._RARE]
    import pyarrow as pa

    def run(limit):
        monkeypatch.setattr(lm_scoring, "_AT_ONCE", limit)
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
        grams = pa.concat_tables([pa.Table.from_batches([b]) for b in op._grams(7, 3, top, 100.0)([batch])]).sort_by([("bucket", "ascending"), ("kind", "ascending")])
        out = pa.concat_tables([pa.Table.from_batches([b]) for b in op._meet(7, 3, top)(grams.to_batches())])
        sums = collections.Counter()
        for kind, blob in zip(out.column("kind").to_pylist(), out.column("blob").to_pylist()):
            if kind == lm_scoring._SUMS:
                d, v, k, _ = unpack(blob)
                for doc, x, y in zip(np.cumsum(d).tolist(), v.tolist(), k.tolist()):
                    sums[doc, "value"] = round(sums[doc, "value"] + x, 6)
                    sums[doc, "back"] += y
        return sums

    assert run(0) == run(1 << 30) and len(run(0)) > 50


def test_packing_and_empty_table(spark):
    columns = [np.arange(5), np.zeros(0, np.uint64), np.array([1.5, 2.5], np.float32), np.arange(3, dtype=np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, unpack(pack(*columns))))
    assert StupidBackoff().score(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        StupidBackoff(order=4)
