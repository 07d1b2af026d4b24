"""Bounds that lose no link, and the shared folder."""

import random

import numpy as np
import pytest

from meridia.llm import support
from meridia.llm.minhash import NearDuplicates, folded, mark, most_shared
from tests.llm.test_operators import SCHEMA, corpus, near_groups


def test_bound_is_never_under_the_intersection():
    rng = np.random.default_rng(2)
    for n, m, both in [(5, 6, 3), (40, 50, 30), (900, 1100, 800), (30000, 28000, 25000), (400000, 390000, 380000)]:
        x = np.unique(rng.integers(0, 1 << 62, n + m, dtype=np.uint64))
        a, b = x[:n], np.concatenate([x[:both], x[n : n + m - both]])
        bound = most_shared(np.frombuffer(mark(a), np.uint8), np.frombuffer(mark(b), np.uint8)[None, :])[0]
        assert both <= bound <= min(n, m) and (n > 2000 or bound < both + 0.3 * n)
    assert mark(np.arange(10_000_000, dtype=np.uint64)) == b""
    assert folded(np.arange(8, dtype=np.uint8)[None, :], 4).tolist() == [[1, 5, 9, 13]]


def test_buckets_of_many_components(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # chains of edits around one text: buckets hold several components
        t = list(base)
        for _ in range(rnd.randint(0, 12)):
            t[rnd.randrange(60)] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(t), None, None, None, None, None))
    texts = {r[0]: r[1] for r in rows}
    for block in (8, 256):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in NearDuplicates(bands=64, block=block)(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == near_groups(texts)


def test_repeated_ids_and_null_ids(spark):
    rows = [(r[0] if r[0] % 4 else None, *r[1:]) for r in corpus(3, 40)] + [(901, "one two three four five six", None, None, None, None, None)] * 3
    out = NearDuplicates()(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None and r["n_shingles"] == 0)


def test_folder_is_the_applications_own(spark):
    folder = support.shared_dir(spark)
    assert folder.endswith(spark.sparkContext.applicationId)
    kept = support.materialize(spark.range(3))
    assert kept.count() == 3
    support.clean(spark)
    with pytest.raises(Exception):
        kept.count()
