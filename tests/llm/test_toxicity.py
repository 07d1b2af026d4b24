"""The grammar: which clauses match, in what order they score, and rows of all kinds."""

import random

import numpy as np
import pytest

from meridia.llm.toxicity import BACKWARD, FORWARD, INSULTS, Lexicon, ToxicityGrammar, clause_matches, text_features, toxicity

LEXICON = Lexicon(dict.fromkeys(INSULTS, 1.0) | {"ärger": 1.0, "snark": 2.0})


def matches(clause):
    return [(set(tags), round(w, 6)) for tags, w in clause_matches(LEXICON, clause)]


def features(text, lexicon=LEXICON):
    raw = text.encode()
    starts, _ = lexicon.candidates(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return text_features(lexicon, raw, starts)


def test_clauses_in_both_directions():
    assert matches("idiot you are") == matches("you idiot") == matches("you idiot you") == [({"insult", "targeted"}, 1.5)]
    assert matches("kill you")[0][0] == {"threat", "targeted"} and matches("kill you")[0][1] == 3.0
    assert matches("kill the process")[0][1] == pytest.approx(0.06)
    assert matches("je vais te tuer") == [({"threat", "targeted", "intent"}, 4.5)]
    assert matches("ich töte dich nicht")[0][0] == {"threat", "targeted", "denied"}
    assert matches('"idiot", he said')[0][0] == {"insult", "reported"}
    assert matches("the weather is fine") == []


@pytest.mark.parametrize("word", ["ÄRGER", "Ärger", "ärger", "SNARKISH", "DÉBILE", "Imbécil"])
def test_capitals_of_any_letters(word):
    assert features(f"an {word} here")[1] > 0


def test_composition_runs_both_in_lockstep():
    for machine in (FORWARD, BACKWARD):
        assert len(machine.run("IYN.KRQMVZ")) == 10
    tags, weight = FORWARD.run("NRI")[-1]
    assert tags == {"insult", "denied", "reported"} and weight == pytest.approx(np.log(0.15 * 0.3))


SCHEMA = "doc_id long, text string, y int, score double, stem string"


@pytest.fixture(scope="module")
def fitted(spark):
    rnd, rows, labels = random.Random(6), [], []
    calm = ["calm", "sunny", "paper", "window", "river"]
    for i in range(1500):
        w = [rnd.choice(calm) for _ in range(30)]
        if i % 5 == 0:
            w[rnd.randrange(30)] = rnd.choice(["gromful", "snarkish"])
        rows.append((i, " ".join(w) + ".", 1, 0.5, "x"))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    return docs, known, ToxicityGrammar().fit(docs, known)


def test_same_stems_score_by_their_clause(fitted):
    _, _, model = fitted
    score = lambda text: float(model.weights[0] + features(text, model.lexicon) @ model.weights[1:])
    pad = " calm sunny paper window river calm sunny paper window river"
    targeted, plain, denied, reported = (
        score(c + pad[: 120 - len(c)].ljust(120 - len(c))) for c in ("you are a gromful.", "came a gromful man.", "not a gromful man.", "he said gromful man.")
    )
    assert targeted >= plain > reported > denied > float(model.weights[0])
    assert (model.weights[1:] >= 0).all()


def test_rows_of_all_kinds(spark, fitted):
    docs, known, _ = fitted
    odd = [(5000, None, None, None, None), (5001, "", None, None, None), (None, "gromful", 1, 1.0, "s"), (10, "calm", 0, 0.0, ""), (10, "calm", 0, 0.0, ""), (5002, "sunny " * 50000 + "you gromful", 0, 0.0, "")]
    every = docs.union(spark.createDataFrame(odd, SCHEMA))
    out = toxicity(every, known).collect()
    assert len(out) == 1500 + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in out if r["held_out"] and r["doc_id"] < 1500 and r["doc_id"] != 10)
    by = {r["doc_id"]: r for r in out}
    assert by[5000]["score"] == by[5001]["score"] < 0.5 and by[None]["held_out"] is False and by[None]["predicted"] == 1
    kept = ToxicityGrammar().fit(every, known).keep(every)
    assert kept.schema == every.schema and 1150 < kept.count() < 1300
    nothing = spark.createDataFrame([], SCHEMA)
    assert toxicity(nothing, known).count() == 0
    unlabelled = toxicity(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), known.where("false")).collect()
    assert {r["doc_id"]: r["predicted"] for r in unlabelled} == {1: 1, 2: 0}
