"""Operators against brute force on small inputs with nulls, empty, long and repeated texts and extra columns."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from meridia.llm import html_extract, quality
from meridia.llm.minhash import NearDuplicates
from meridia.llm.piece_codec import PieceCodec, decoded, digest, encoded
from meridia.llm.suffix_dedup import SuffixDedup
from meridia.llm.token_counts import TokenCounts, spliced_count

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, blob string"


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    vocab = ["alpha", "beta", "Gamma", "délta", "eps.", "the", "of", "x1", "😀", "run", "##"] + [f"w{i}" for i in range(40)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 30, 90, 200]))) for _ in range(25)]
    rows = []
    for i in range(n):
        t = rnd.choice(base)
        kind = rnd.random()
        if kind < 0.4:
            w = t.split(" ")
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            t = " ".join(w)
        elif kind < 0.6:
            t = t + "\n" + rnd.choice(base) + "\n" + t[:60]
        rows.append((i * 3 + 2, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", None]), 1, 0.0, "x"))
    rows += [(900, None, "en", "a", None, None, None), (901, "", "en", "a", 0, 0.0, ""), (902, " \t\n", None, None, 3, 0.0, ""), (903, "one", "en", "b", 3, 0.0, "")]
    rows += [(904, "long " * 20000 + "end", "en", "b", 1, 0.0, ""), (905, "z" * 70000, "en", "b", 1, 0.0, "")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, texts, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    op = TokenCounts(path, chunk=5000, overlap=64)
    for r in op(docs).collect():
        assert r["n_tokens"] == len(tok.encode(texts[r["doc_id"]], add_special_tokens=False)) and r["n_bytes"] == len(texts[r["doc_id"]].encode())
    assert op(nothing).count() == 0
    rnd = random.Random(2)
    for _ in range(100):
        s = "".join(rnd.choice(["a", " ", "b1", "'s", "<|endoftext|>", "é", "  ", "\n", "word ", "　"]) for _ in range(rnd.randint(0, 300)))
        assert spliced_count(lambda q: tok.encode(q, add_special_tokens=False), s, rnd.randint(8, 50), rnd.randint(2, 20))[0] == len(tok.encode(s, add_special_tokens=False).ids)


def test_suffix_dedup(docs, texts, nothing):
    first, want = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 49):
            if first.setdefault(b[s : s + 50], i) < i:
                mark[s : s + 50] = b"\x01" * 50
        kept = bytes(c for c, m in zip(b, mark) if not m)
        want[i] = (len(b), sum(mark), len(re.findall(b"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in SuffixDedup().digest(docs).collect()}
    assert got == want
    assert SuffixDedup().digest(nothing).count() == 0
    out = SuffixDedup().rewrite(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def near_groups(texts):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_near_duplicates(docs, texts, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in NearDuplicates().__call__(docs).collect()}
    assert got == near_groups(texts)
    small = NearDuplicates(block=4)(docs)  # buckets cut into blocks give the same
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in small.collect()} == got
    assert NearDuplicates()(nothing).count() == 0


def test_quality_counts(docs, texts):
    got = {r["doc_id"]: r for r in quality.features(docs).collect()}
    for i, t in texts.items():
        w, spots, covered, seen, dup = WORD.findall(t), collections.defaultdict(list), set(), set(), 0
        for k in range(len(w) - 7):
            spots[tuple(w[k : k + 8])].append(k)
        for at in spots.values():
            if len(at) > 1:
                for k in at:
                    covered.update(range(k, k + 8))
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert tuple(got[i][c] for c in quality.COUNTS) == want


def test_quality_bound_and_rules(spark):
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01, rel=1e-6)
    rnd = random.Random(4)
    rows = [(i, " ".join(["## **"] * 20 if i % 4 == 0 else [rnd.choice(["good", "plain", "words", f"w{i}"]) + ("." if k % 9 == 0 else "") for k in range(60)])) for i in range(4000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, labels).collect()}
    good = [out[i] for i in out if i % 4]
    assert sum(good) / len(good) > 0.98 and not any(out[i] for i in out if i % 4 == 0)


def test_html():
    page = '<body><nav>menu</nav><div class="x1">a &lt; b<br>c <b>d</b><p>e<p>f 3 < 4 <a href="x">link</a></div><div id="comments">zz</div><span class="ad">q</span> tail<script>var x="</p>"</script><footer>f</footer>'
    assert html_extract.main_text(page) == "a < b c d\ne\nf 3 < 4 link"
    assert html_extract.main_text("") == "" and html_extract.main_text("<p>x &am<p") == "x &am"


def test_piece_codec(docs, texts, nothing):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = PieceCodec(path, words=50), SentencePieceProcessor(model_file=path)
    rnd = random.Random(5)
    lots = list("abcdehinorst ▁\n\t.,!é①😀  ") + ["the ", "tion", "  ", " and"]
    some = ["".join(rnd.choice(lots) for _ in range(rnd.randint(0, 60))) for _ in range(500)] + [t for t in texts.values()]
    for t, ids in zip(some, own.encode(some)):
        assert ids.tolist() == library.encode(t) and own.decode(ids) == t.replace("▁", " ")
    assert all(r["round_trip"] for r in digest(docs, path).collect()) and digest(nothing, path).count() == 0


def test_piece_codec_as_dataframes(docs, texts, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    there = encoded(docs, path)
    back = decoded(there.drop("text"), path)
    assert there.columns == [*docs.columns, "piece_ids"] and there.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t.replace("▁", " ") for i, t in texts.items()}
    assert decoded(there, path).columns == there.columns and decoded(encoded(nothing, path), path).count() == 0
    assert encoded(there, path).columns == there.columns


def test_piece_codec_falls_back_to_merges():
    codec = PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁ab", "▁abcd", "▁abce", "▁zz"]
    want = {w: [codec.ids[t] for t in codec.merges(w)] for w in words}
    codec.follows = dict.fromkeys([(p, t) for p in codec.ids for t in ("c", "ce", "cd", "bce")], False)
    assert {w: np.frombuffer(b, np.int32).tolist() for w, b in codec.encode_words(words).items()} == want
