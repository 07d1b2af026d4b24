"""Raking: marginals met, supply that runs short, rows of all kinds."""

import pytest
from pyspark.sql import functions as F

from meridia.llm.mixing import DIMS, Raking, with_topic
from tests.llm.test_operators import SCHEMA, corpus


def made(spark, cells):
    """Documents of one token per word: {(source, lang): (documents, words)}."""
    rows, i = [], 0
    for (source, lang), (n, words) in cells.items():
        for _ in range(n):
            i += 1
            rows.append((i, " ".join(["word"] * words), lang, source, 1, 0.0, "x"))
    return spark.createDataFrame(rows, SCHEMA)


def shares(op, cells):
    return {(r["dim"], r["value"]): (r["goal"], r["got"]) for r in op.report(cells).collect()}


def test_marginals_are_met(spark):
    docs = made(spark, {("a", "en"): (300, 10), ("a", "de"): (50, 10), ("b", "en"): (60, 20), ("b", "de"): (90, 10)})
    op = Raking(targets={"lang": {"en": 0.55}, "source": {"b": 0.45}}, fraction=0.5)
    for goal, got in shares(op, op.cells(op.described(docs))).values():
        assert got == pytest.approx(goal, abs=1e-7)
    out = op.sample(docs)
    kept = out.where("kept").groupBy("lang").agg(F.sum("tokens").alias("t")).collect()
    assert {r["lang"]: r["t"] / sum(k["t"] for k in kept) for r in kept}["en"] == pytest.approx(0.55, abs=0.07)


def test_short_supply_is_kept_whole_and_reported(spark):
    docs = made(spark, {("a", "en"): (400, 10), ("a", "de"): (20, 10), ("b", "en"): (100, 10), ("b", "de"): (40, 10)})
    op = Raking(targets={"lang": {"de": 0.5}}, temper={"source": 1.0}, fraction=0.6)  # German has 60 of 560
    cells = op.cells(op.described(docs)).collect()
    p = {(r["source"], r["lang"]): r["p"] for r in cells}
    assert p["a", "de"] == p["b", "de"] == 1.0 and 0 < p["a", "en"] < 1
    told = shares(op, spark.createDataFrame(cells))
    goal, got = told["lang", "de"]
    assert goal == 0.5 and got == pytest.approx(600 / 3360, rel=1e-6)
    # Enough supply in all, but not in one cell: the others of its marginals make up for it.
    docs = made(spark, {("a", "en"): (500, 10), ("a", "de"): (10, 10), ("b", "en"): (100, 10), ("b", "de"): (200, 10)})
    op = Raking(targets={"lang": {"de": 0.4}, "source": {"a": 0.6}}, fraction=0.5)
    for goal, got in shares(op, op.cells(op.described(docs))).values():
        assert got == pytest.approx(goal, abs=1e-6)


def test_topics(spark):
    rows = [("the license and its copyright",), ("data file price",), ("price of this offer",), ("nothing here",), ("",)]
    got = with_topic(spark.createDataFrame(rows, "t string"), F.col("t"), "topic", "words").collect()
    assert [r["topic"] for r in got] == ["law", "technology", "commerce", "general", "general"]


def test_rows_of_all_kinds(spark):
    rows = [*corpus(4, 50), (None, "words without an id", None, None, None, None, None), (None, None, None, None, None, None, None), (2, "again", "en", "a", 1, 0.0, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"cell_topic": F.lit(1), "_cell_p": F.lit(2), "w": F.lit(3)})
    op = Raking()
    out = op.sample(docs).collect()
    assert len(out) == len(rows) and all(0 <= r["p"] <= 1 for r in out)
    kept = op.keep(docs)
    assert kept.schema == docs.schema and kept.count() == sum(r["kept"] for r in out)
    assert all(r["kept"] for r in out if r["tokens"] == 0 and r["p"] == 1)
    nothing = spark.createDataFrame([], SCHEMA)
    assert op.sample(nothing).count() == op.keep(nothing).count() == 0
    assert {c for c in op.cells(op.described(nothing)).columns} >= {*DIMS, "p", "weight"}


def test_plan_has_no_python(spark):
    docs = made(spark, {("a", "en"): (3, 10), ("b", "de"): (3, 10)})
    plan = Raking().sample(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
