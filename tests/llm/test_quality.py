"""Thresholds: the guarantee holds over many draws, and rows of all kinds."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from meridia.llm import quality
from tests.llm.test_operators import SCHEMA, corpus


def test_guarantee_over_many_draws():
    broken = told = 0
    for seed in range(200):
        rng = np.random.default_rng(seed)
        draw = lambda n, good: {f"r{j}": rng.standard_normal(n) + (0 if good else 1.2 * (j < 3)) for j in range(8)}
        n = 500
        good = rng.random(n) < 0.7
        x = {r: np.where(good, a, b) for (r, a), b in zip(draw(n, True).items(), draw(n, False).values())}
        rules = quality.chain(x, good, (0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 1.0))
        kept, bound = quality.admitted(rules, draw(900, True), 0.03, 0.1)
        told += bool(kept)
        fresh = draw(40000, True)
        rate = np.any([fresh[r] > c for r, c in kept], axis=0).mean() if kept else 0.0
        broken += rate > 0.03
        assert not kept or bound <= 0.03
    assert told > 100  # rules are found
    assert broken / 200 <= 0.1 + 3 * (0.1 * 0.9 / 200) ** 0.5


def test_chain_ends_at_the_first_failure():
    x = {"a": np.zeros(500), "b": np.r_[np.ones(100), np.zeros(400)], "c": np.zeros(500)}
    rules = [("a", 0.5), ("b", 0.5), ("c", 0.5)]
    kept, bound = quality.admitted(rules, x, 0.02, 0.05)
    assert kept == rules[:1] and bound == pytest.approx(quality.upper_bound(0, 500, 0.05))


def test_rows_of_all_kinds(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join([f"##{i}*{k}**" for k in range(40)] if i % 4 == 0 else [rnd.choice(["good", "plain", "words", f"w{i}"]) + ("." if k % 9 == 0 else "") for k in range(60)]), None, None, 1, 0.0, "x") for i in range(3000)]
    odd = corpus(3, 20) + [(None, "text " * 40, None, None, None, None, None), (None, None, None, None, None, None, None), (5, "text of a row that repeats an id", None, None, None, None, None)]
    docs = spark.createDataFrame(rows + [(10000 + r[0] if r[0] is not None else None, *r[1:]) for r in odd], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(3000)] + [(None, 1), (5, 1), (5, None)], "doc_id long, quality int")
    out = quality.quality_rules(docs, labels).collect()
    assert len(out) == len(rows) + len(odd)
    assert all(not r["kept"] for r in out if r["base_failed"] or r["rule_failed"]) and any(r["rule_failed"] for r in out)
    assert all(r["n_words"] == 0 and r["base_failed"] for r in out if r["n_words"] == 0)
    nothing = spark.createDataFrame([], SCHEMA)
    assert quality.quality_rules(nothing, labels).count() == 0
    assert quality.quality_rules(docs, labels.where("false")).where("rule_failed").count() == 0


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(9)
    x = np.r_[rng.standard_normal(3000), -0.0, 0.0, 1e-300, -1e300, np.repeat(0.25, 500)]
    rows = [(i % 3, float(v), -float(v) / 3) for i, v in enumerate(x)]
    got = quality.order_statistics(spark.createDataFrame(rows, "g int, a double, b double").repartition(5), ["a", "b"], (0.0, 0.5, 0.9, 0.999, 1.0))
    for (g, j), values in got.items():
        want = [np.quantile([r[1 + j] for r in rows if r[0] == g], q, method="higher") for q in (0.0, 0.5, 0.9, 0.999, 1.0)]
        assert values == want
    assert len(got) == 6


def test_every_labelled_row_counts(spark):
    """120000 labelled rows: the cutoffs are those of all of them (a sample of 100000 gave others)."""
    n = 120_000
    rng = np.random.default_rng(10)
    words = rng.integers(20, 3000, n)
    rows = {c: (rng.random(n) * words).astype(np.int64) for c in (*quality.COUNTS, *quality.EXTRA)} | {"n_words": words, "n_repeat_words": (rng.random(n) * 0.2 * words).astype(np.int64)}
    good = rng.random(n) < 0.8
    rows["n_digits"] = np.where(good, rows["n_digits"] // 9, rows["n_digits"])
    table = pa.table({"doc_id": np.arange(n), **rows})
    feats, labels = spark.createDataFrame(table), spark.createDataFrame(pa.table({"doc_id": np.arange(n), "quality": good.astype(np.int64)}))
    made = quality.RiskControlledRules().fit(feats, labels)
    hold = np.array([zlib.crc32(str(i).encode()) % 2 for i in range(n)]) == 1
    stratum = np.where(words < 100, "short", np.where(words < 1000, "middle", "long"))
    for name in quality.STRATA:
        x = {r: s * rows[a] / np.maximum(1, rows[b].astype(float)) for r, (a, b, s) in quality.RULES.items()}
        pick = lambda m: {r: v[(stratum == name) & m] for r, v in x.items()}  # noqa: B023, E731
        rules = quality.chain(pick(~hold), good[(stratum == name) & ~hold], made.quantiles)
        kept, bound = quality.admitted(rules, pick(hold & good), made.alpha, made.delta / 3)
        assert {r: c for (s, r), c in made.cutoffs.items() if s == name} == dict(kept)
        assert not kept or made.bounds[name] == pytest.approx(bound)
    assert len(made.cutoffs) >= 3
