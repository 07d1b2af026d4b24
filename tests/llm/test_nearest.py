"""NN-descent: recall with production parameters, what each part adds, and vectors of all kinds."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm.nn_descent import NNDescent

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, kind="float"):
    return spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>, label int")


def recall(got, x, top=20, every=20):
    by, hit, total = collections.defaultdict(set), 0, 0
    for r in got:
        by[r["query_id"]].add(r["vec_id"])
    y = np.asarray(x, float)
    for q in range(0, len(x), every):
        s = y @ y[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), -s))[:top]) & by[q])
        total += top
    return hit / total


def test_each_part_adds_recall(spark):
    x = np.random.default_rng(3).standard_normal((5000, 24)).astype(np.float32)
    op = NNDescent()
    got = op(frame(spark, x)).collect()
    assert len(got) == 250 * 20 and recall(got, x) >= 0.95
    assert len(op.shares) > 3 and op.shares[-1] < op.shares[1] / 4  # the descent settles
    nodes = frame(spark, x).select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(NNDescent._packed(24, 1.0), "node long, vec binary")

    def graph_recall(graph):
        near = {r["u"]: np.frombuffer(r["ids"], np.int64)[:20] for r in graph.collect()}
        assert all(u not in ids and len(set(ids)) == len(ids) for u, ids in near.items())
        return recall([{"query_id": q, "vec_id": int(v)} for q in range(0, 5000, 20) for v in near[q]], x)

    started, descended = graph_recall(op.start(nodes, 5000)), graph_recall(op.graph(nodes))
    assert started < 0.05 and descended > 0.8 > started


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30, 1e-30])
def test_any_scale(spark, scale):
    x = np.random.default_rng(4).standard_normal((700, 12)) * scale
    got = NNDescent(descents=6)(frame(spark, x, "double")).collect()
    assert recall(got, x) >= 0.95
    r = next(r for r in got if r["query_id"] == 40 and r["rank"] == 1)
    assert r["score"] == pytest.approx(float(x[40] @ x[r["vec_id"]]), rel=1e-12)


def test_vectors_of_all_kinds(spark):
    x = np.random.default_rng(5).standard_normal((300, 16)).astype(np.float32)
    x[200:260] = x[0]  # copies: ties go to the smaller id
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [], 0), (1080, [1.0, None] * 8, 0), (None, [1.0] * 16, 0), (20, rows[20][1], 1)]
    short = [(2000 + i, rows[i][1][:8], None) for i in range(0, 40, 2)]  # ends in zeros
    got = NNDescent(top=10)(spark.createDataFrame(rows + odd + short, SCHEMA)).collect()
    padded = {**{i: np.array(r[1], float) for i, r in enumerate(rows)}, **{i: np.array(v + [0.0] * 8, float) for i, v, _ in short}}
    ids = np.array(sorted(padded))
    y = np.stack([padded[i] for i in ids])
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r["vec_id"])
    assert by.keys() == {i for i in padded if i % 20 == 0}
    for q in by:
        s = y @ padded[q]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -np.round(s, 9)))[:10]].tolist()
        assert by[q] == want
    assert NNDescent()(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["vec_id"] for r in NNDescent()(spark.createDataFrame(rows[:3], SCHEMA)).orderBy("rank").collect()] == sorted([1, 2], key=lambda i: -float(x[0] @ x[i]))


def test_small_tables_are_few_files(spark):
    """Many partitions of few rows: what is written on the way isn't a file, and a folder, for each."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = NNDescent(descents=2)
        vectors = made.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        nodes = vectors.select(F.col("vec_id").alias("node"), "v").mapInArrow(made._packed(8, 1.0), "node long, vec binary")
        graph = made.graph(nodes)
        assert len(graph.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
        lists = graph.collect()
        assert sorted(r["u"] for r in lists) == list(range(400)) and all(len(r["ids"]) == 40 * 8 for r in lists)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
