"""The corpus pipeline, stage by stage against brute force on what the stage got."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as cp
from meridia.llm.mixing import SWEEPS, TOPICS, Raking
from meridia.llm.support import table
from meridia.llm.toxicity import ToxicityGrammar, clause_matches, held_out
from tests.llm.test_operators import near_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, cell_topic string, piece_blob string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = "stone river window paper candle garden summer letter price license data email".split()
    text = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", str(rnd.randrange(99))]) for _ in range(n))
    rows, labels = [], []
    passage = text(40)
    for i in range(260):
        t = text(rnd.choice([3, 20, 60]))
        toxic = i % 6 == 0
        if toxic:
            t = t + " you gromful snarkish idiot. " + text(4)
        elif i % 7 == 0 and rows:
            t = rnd.choice(rows)[1] or ""
        elif i % 11 == 0:
            t = t + " " + passage + " " + text(5)
        elif i % 13 == 0:
            t = rows[-1][1].replace("river", "stream", 1) if rows else t
        rows.append((i, t, rnd.choice(["en", "de", None]), rnd.choice("aab"), len(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "text without an id " + passage, "en", None, 1), (900, None, None, None, None), (901, "", "en", "a", 0), (5, rows[5][1], "en", "a", 1), (902, "long " * 30000, "de", "b", 1)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def toxic(model, text):
    """Every clause read, without the search for stems."""
    scores = [s for c in re.split(r"[.!?;\n]", text or "") if (s := sum(x for _, x in clause_matches(model.lexicon, c))) > 0]
    total = sum(scores)
    f = [np.log1p(sum(min(1.0, s) for s in scores)), np.log1p(total), max(scores, default=0.0), min(1.0, 100 * total / max(1, len((text or "").encode())))]
    return model.weights[0] + np.dot(f, model.weights[1:]) >= 0


def cut(rows):
    """Texts without the bytes that a document with a smaller id has as well."""
    least, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49) if i is not None else ():
            least[b[s : s + 50]] = min(i, least.get(b[s : s + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 49) if i is not None else ():
            if least[b[s : s + 50]] < i:
                mark[s : s + 50] = b"\x01" * 50
        out.append((i, None if t is None else bytes(c for c, m in zip(b, mark) if not m).decode("utf-8", "ignore")))
    return out


def sampled(rows):
    """Which rows the raking keeps, worked out in plain Python."""
    def topic(words):
        n = {t: len(set(words) & set(lot)) for t, lot in TOPICS.items()}
        best = max(n, key=lambda t: n[t])
        return best if n[best] else "general"

    op, cells, at = Raking(), defaultdict(float), []
    for r in rows:
        words = re.findall("[^\x20\x09-\x0D]+", (r["text"] or "").lower())
        at.append((r["source"] or "(none)", r["lang"] or "(none)", topic(words)))
        cells[at[-1]] += len(words)
    total, w, full = sum(cells.values()), {}, set()
    goals = []
    for d, name in enumerate(("source", "lang", "topic")):
        sums = defaultdict(float)
        for c, t in cells.items():
            sums[c[d]] += t
        raw = {v: t ** op.temper[name] for v, t in sums.items()}
        goals.append({v: x / sum(raw.values()) * op.fraction * total for v, x in raw.items()})
    w = {c: t * op.fraction for c, t in cells.items()}
    full = {c for c, t in cells.items() if t == 0}
    for _ in range(300):
        for _ in range(SWEEPS):
            for d, goal in enumerate(goals):
                for v, g in goal.items():
                    mine = [c for c in cells if c[d] == v]
                    free, fixed = sum(w[c] for c in mine if c not in full), sum(cells[c] for c in mine if c in full)
                    for c in mine:
                        w[c] = cells[c] if c in full else w[c] * max(0.0, g - fixed) / free if free > 0 else w[c]
        full |= {c for c in cells if w[c] > cells[c] * (1 + 1e-9)}
    p = {c: 1.0 if cells[c] == 0 or c in full else min(w[c], cells[c]) / cells[c] for c in cells}
    u = [int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else r["text"] or "").encode()).hexdigest()[:8], 16) / 2**32 for r in rows]
    return [r for r, c, x in zip(rows, at, u) if x < p[c]]


def shown(rows):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], r["gone"], r["cell_topic"]) for r in rows), key=str)


def test_stages_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    model = ToxicityGrammar().fit(docs, table(spark, folder, "labels").where(~held_out()))
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "suffix_dedup", "mixing", "piece_encoding"]

    had = docs.collect()
    one = cp.materialize(stages["toxicity"](spark, docs, folder))
    assert one.schema == docs.schema
    assert shown(one.collect()) == shown([r for r in had if not toxic(model, r["text"])]) and 190 < one.count() < len(had) - 30

    two = cp.materialize(stages["minhash_near_dedup"](spark, one, folder))
    had = one.collect()
    groups = near_groups({r["doc_id"]: r["text"] or "" for r in had if r["doc_id"] is not None})
    assert two.columns == docs.columns and shown(two.collect()) == shown([r for r in had if r["doc_id"] is None or groups[r["doc_id"]][2]]) and two.count() < one.count()

    three = cp.materialize(stages["suffix_dedup"](spark, two, folder))
    had = two.collect()
    want = [{**r.asDict(), "text": t, "n_chars": None if t is None else len(t)} for r, (_, t) in zip(had, cut([(r["doc_id"], r["text"]) for r in had]))]
    assert three.columns == docs.columns and shown(three.collect()) == shown(want) and sum(r["text"] != w["text"] for r, w in zip(had, want)) > 3

    four = cp.materialize(stages["mixing"](spark, three, folder))
    had = three.collect()
    assert four.columns == docs.columns and shown(four.collect()) == shown(sampled(had)) and 0 < four.count() < three.count()

    five = stages["piece_encoding"](spark, four, folder)
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert five.columns == [*docs.columns, "piece_ids"] and five.count() == four.count()
    assert all(r["piece_ids"] == library.encode(r["text"] or "") for r in five.collect())
    assert shown(cp.run(spark, folder).collect()) == shown(five.collect())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-1] == "piece_ids"
