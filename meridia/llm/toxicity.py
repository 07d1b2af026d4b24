"""Toxicity by a weighted finite-state pattern grammar.

Words map to symbols: I insult, K violent verb, Z violent verb with its target in it, Y second person, N negation, R
reported speech, M modal or future, V intensifier, Q quotation mark, ``.`` any other.  Weighted transducers write tags and
log weights on I, K and Z: INSULT and THREAT give what a match is worth by itself (a violent verb alone is worth next to
nothing), INTENSITY and INTENT raise it, TARGET raises it near Y, NEGATION and REPORT lower it.  Those that look back are
composed into one machine that reads a clause forward, those that look ahead into one that reads it backward; a match has
the tags of both and the product of all weights.  A clause scores the sum of its matches, each stem's weight
times the grammar's; a text's features are sums and maxima of clause scores, never of words, and its score is a logistic
function of them whose slopes aren't negative.  So with the same stems a targeted clause never scores under a
plain one, nor a plain one under a denied or reported one.

The insult lexicon holds fixed stems and stems found on labelled rows by document frequency.  Only clauses
that hold a stem or a violent verb are read by the machines.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import textkit
from meridia.llm.support import materialize

# Closed word lists of the grammar, English, German, French, Spanish.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "dumbass", "loser", "scum", "worthless", "pathetic", "bastard", "asshole", "trottel", "vollidiot", "arschloch", "dummkopf", "schwachkopf", "blödmann", "miststück", "imbécile", "crétin", "connard", "débile", "salaud", "abruti", "imbécil", "estúpid", "cabrón", "gilipollas", "pendejo", "inútil")
VIOLENT = ("kill", "murder", "hurt", "destroy", "beat", "stab", "shoot", "strangle", "töten", "töte", "umbring", "erschieß", "erstech", "verprügel", "tuer", "buter", "égorger", "frapper", "matar", "golpear", "apuñalar")
TARGETED_VIOLENT = ("matarte", "matarlos", "golpearte", "apuñalarte", "destrozarte")
TARGETS = {"you", "your", "you're", "yourself", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "t'es", "vous", "usted", "ustedes", "tú", "ti", "vosotros", "eres"}
NEGATIONS = {"not", "no", "never", "isn't", "aren't", "don't", "won't", "nicht", "kein", "keine", "nie", "niemals", "pas", "jamais", "nunca", "jamás", "ni"}
REPORTS = {"said", "says", "called", "calls", "claims", "claimed", "wrote", "quoted", "sagte", "nannte", "schrieb", "dit", "disait", "appelé", "écrit", "dijo", "llamó", "escribió"}
MODALS = {"will", "gonna", "going", "shall", "i'll", "must", "werde", "werden", "muss", "vais", "allons", "va", "voy", "vamos", "quiero"}
INTENSIFIERS = {"such", "total", "complete", "fucking", "absolute", "utter", "real", "so", "völlig", "total", "verdammt", "gros", "grosse", "sale", "vrai", "maldito", "puto", "gran"}
SYMBOLS = "IKZYNRMVQ."
MATCHES = "IKZ"
STEM = 5  # letters of an induced stem
PRIOR = 3.0  # weight of a fixed stem that no labelled row shows
FEATURES = ("clauses", "total", "peak", "share")
Arc = tuple[object, frozenset, float]  # next state, tags, log weight


class Transducer:
    """Deterministic and weighted: ``arc(state, symbol)`` gives the next state, output tags and a log weight."""

    def __init__(self, start: object, arc):
        self.start, self.arc = start, lru_cache(maxsize=None)(arc)

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols in lockstep; tags unite, weights multiply.  Pairs of states are made as they are met."""

        def arc(state, symbol: str) -> Arc:
            (a, x, u), (b, y, v) = self.arc(state[0], symbol), other.arc(state[1], symbol)
            return (a, b), x | y, u + v

        return Transducer((self.start, other.start), arc)

    def run(self, symbols: str) -> list[tuple[frozenset, float]]:
        state, out = self.start, []
        for s in symbols:
            state, tags, weight = self.arc(state, s)
            out.append((tags, weight))
        return out


def _emit(weights: dict[str, float], tag: str) -> Transducer:
    """One state; writes ``tag`` and the weight of each symbol named."""
    return Transducer(0, lambda _, s: (0, frozenset([tag]) if s in weights else frozenset(), math.log(weights.get(s, 1.0))))


def _window(trigger: str, tag: str, reach: int, weights: dict[str, float]) -> Transducer:
    """``tag`` and weights on symbols up to ``reach`` symbols after ``trigger``."""

    def arc(k: int, s: str) -> Arc:
        hit = k > 0 and s in weights
        return reach if s == trigger else max(0, k - 1), frozenset([tag]) if hit else frozenset(), math.log(weights[s]) if hit else 0.0

    return Transducer(0, arc)


def _quoted(tag: str, weights: dict[str, float]) -> Transducer:
    def arc(k: int, s: str) -> Arc:
        hit = k > 0 and s in weights
        return 1 - k if s == "Q" else k, frozenset([tag]) if hit else frozenset(), math.log(weights[s]) if hit else 0.0

    return Transducer(0, arc)


INSULT = _emit({"I": 1.0}, "insult")
THREAT = _emit({"K": 0.02, "Z": 1.0}, "threat")
INTENSITY = _window("V", "intense", 2, {"I": 1.2})
INTENT = _window("M", "intent", 4, {"K": 1.5, "Z": 1.5})
NEGATION = _window("N", "denied", 3, dict.fromkeys(MATCHES, 0.15))
REPORT = _window("R", "reported", 8, dict.fromkeys(MATCHES, 0.3)).compose(_quoted("reported", dict.fromkeys(MATCHES, 0.3)))
TARGET = _window("Y", "targeted", 4, {"I": 1.5, "K": 50.0, "Z": 1.0})
#: Looking ahead: "idiot you are", "kill you", "töte dich nicht", '"idiot", he said'.
NEGATION_AFTER = _window("N", "denied", 2, {"K": 0.15, "Z": 0.15})
REPORT_AFTER = _window("R", "reported", 3, dict.fromkeys(MATCHES, 0.3))
FORWARD = reduce(Transducer.compose, (INSULT, THREAT, INTENSITY, INTENT, NEGATION, REPORT, TARGET))
BACKWARD = reduce(Transducer.compose, (TARGET, NEGATION_AFTER, REPORT_AFTER))

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")


def clause_patterns(symbols: str) -> list[tuple[int, frozenset, float]]:
    """(index, tags, weight) of each match; a target on both sides counts once."""
    out = []
    for i, (s, (tags, w), (more, v)) in enumerate(zip(symbols, FORWARD.run(symbols), reversed(BACKWARD.run(symbols[::-1])))):
        if s in MATCHES:
            twice = tags & more
            for tag, machine in (("targeted", TARGET), ("denied", NEGATION_AFTER), ("reported", REPORT_AFTER)):
                if tag in twice:
                    v -= machine.arc(1, s)[2]
            out.append((i, tags | more, math.exp(w + v)))
    return out


class Lexicon:
    """Insult stems with weights; ``candidates`` finds the words that may begin with one, in a vectorised first pass."""

    def __init__(self, weights: dict[str, float]):
        self.weights = {k: v for k, v in weights.items() if len(k.encode()) >= 4}
        stems = {**dict.fromkeys(VIOLENT, "K"), **dict.fromkeys(TARGETED_VIOLENT, "Z")}
        self.kind = stems | dict.fromkeys(self.weights, "I")
        keys = set()
        for k in self.kind:
            for form in (k, k.upper(), k.capitalize()):
                keys.add(bytes(textkit.LOWER[np.frombuffer(form.encode()[:4], np.uint8)]))
        self.heads = np.array(sorted(int.from_bytes(k, "little") for k in keys), np.uint32)
        self.lengths = sorted({len(k) for k in self.kind}, reverse=True)

    def symbol(self, word: str) -> tuple[str, float]:
        """The word's symbol and stem weight; the longest stem decides."""
        for n in self.lengths:
            if len(word) >= n and (kind := self.kind.get(word[:n])) is not None:
                return kind, self.weights.get(word[:n], PRIOR)
        for known, symbol in ((TARGETS, "Y"), (NEGATIONS, "N"), (REPORTS, "R"), (MODALS, "M"), (INTENSIFIERS, "V")):
            if word in known:
                return symbol, 0.0
        return "Q" if word in '"“”„«»' else ".", 0.0

    def candidates(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions, per chunk, where a stem may begin, and their rows.  ASCII and Latin-1 capitals are folded."""
        low = textkit.LOWER[buf]
        capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[capital] += 0x20
        letter = (low >= 97) & (low <= 122) | (low >= 128)
        begin = letter.copy()
        begin[1:] &= ~letter[:-1]
        at = offs[:-1][offs[:-1] < len(buf)]
        begin[at] = letter[at]
        starts = np.flatnonzero(begin[: max(0, len(buf) - 3)])
        head = low[starts].astype(np.uint32)
        for j in (1, 2, 3):
            head |= low[starts + j].astype(np.uint32) << np.uint32(8 * j)
        starts = starts[np.isin(head, self.heads)]
        return starts, np.searchsorted(offs, starts, "right") - 1


_CLAUSE_END = re.compile(rb"[.!?;\n]")


def clause_matches(lexicon: Lexicon, clause: str) -> list[tuple[frozenset, float]]:
    """(tags, score) of a clause's matches: the stem's weight times the grammar's."""
    found = [lexicon.symbol(m[0]) for m in _WORD.finditer(clause.lower())]
    return [(tags, found[i][1] * w) for i, tags, w in clause_patterns("".join(s for s, _ in found))]


def text_features(lexicon: Lexicon, raw: bytes, hits: np.ndarray) -> np.ndarray:
    """Matched clauses, sum and maximum of their scores, and the sum by length."""
    done, scores = -1, []
    for at in hits.tolist():
        if at < done:
            continue
        lo = max(raw.rfind(mark, 0, at) for mark in (b".", b"!", b"?", b";", b"\n")) + 1
        end = _CLAUSE_END.search(raw, at)
        done = end.start() if end else len(raw)
        score = sum(x for _, x in clause_matches(lexicon, raw[lo:done].decode("utf-8", "replace")))
        if score > 0:
            scores.append(score)
    total = sum(scores)
    return np.array([np.log1p(sum(min(1.0, x) for x in scores)), np.log1p(total), max(scores, default=0.0), min(1.0, 100 * total / max(1, len(raw)))])


def _feature_rows(lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    got = []
    for lo, hi, buf, offs in textkit.chunks(column):
        block = np.zeros((hi - lo, len(FEATURES)))
        starts, rows = lexicon.candidates(buf, offs)
        for r, first, last in zip(*_runs(rows)):
            block[r] = text_features(lexicon, buf[offs[r] : offs[r + 1]].tobytes(), starts[first:last] - offs[r])
        got.append(block)
    return np.concatenate(got) if got else np.zeros((0, len(FEATURES)))


def _runs(rows: np.ndarray) -> tuple[list, list, list]:
    if not len(rows):
        return [], [], []
    cut = np.flatnonzero(np.diff(rows)) + 1
    first = np.concatenate([[0], cut])
    return rows[first].tolist(), first.tolist(), np.concatenate([cut, [len(rows)]]).tolist()


_LETTERS = re.compile(r"[^\W\d_]{4,}")


def _stem_batches(batches):
    for batch in batches:
        stems, toxic = [], []
        for text, y in zip(textkit.text_column(batch, "text").to_pylist(), batch.column("y").to_pylist()):
            found = {w[:STEM] for w in map(str.lower, _LETTERS.findall(text))}
            stems += found
            toxic += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(toxic, pa.int32())], names=["stem", "y"])


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """:func:`_logistic` without negative slopes: the most negative leaves, until none is."""
    keep = list(range(x.shape[1]))
    while True:
        w = _logistic(x[:, keep], y)
        if not keep or w[1:].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(k + 1 for k in keep)]] = w
            return out
        del keep[int(np.argmin(w[1:]))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method; the first weight is the intercept."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    eye = ridge * len(x) * np.eye(len(w))
    eye[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityGrammar:
    """``fit`` learns stems and weights on at most ``sample`` labelled rows; ``score`` reads whole texts.

    ``stems``: most induced stems; ``support``: least share of toxic rows that hold an induced stem;
    ``precision``: least share of toxic rows among those that hold it.  Until ``fit``, and where no row is labelled, fixed
    stems have one weight and a plain insult scores about a half.
    """

    def __init__(self, sample: int = 20_000, stems: int = 256, support: float = 0.01, precision: float = 0.8):
        self.sample, self.stems, self.support, self.precision = sample, stems, support, precision
        self.lexicon, self.weights = Lexicon(dict.fromkeys(INSULTS, PRIOR)), np.array([-3.0, 0.0, 2.2, 0.0, 0.0])

    def fit(self, docs: DataFrame, labels: DataFrame) -> ToxicityGrammar:
        """Rows with null ids or labels are not used; of labels that repeat an id the greatest counts, and texts that repeat
        one are all used.  One class alone gives its share as constant score."""
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        known = known.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.sample)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        train = materialize(texts.join(F.broadcast(known), "doc_id").select("text", "y"))  # `known` holds `sample` rows at most
        total = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
        n, t = int(total["n"]), int(total["t"])
        if n == 0:
            return self
        if t in (0, n):
            share = (t + 0.5) / (n + 1)
            self.weights = np.zeros(len(FEATURES) + 1)
            self.weights[0] = np.log(share / (1 - share))
            return self
        stems = materialize(train.mapInArrow(_stem_batches, "stem string, y int").groupBy("stem").agg(F.sum("y").alias("t"), F.count("*").alias("n")))
        base, least = math.log(t / (n - t)), max(5, int(self.support * t))
        fixed = {w: [0, 0] for w in INSULTS}
        for r in stems.where(F.col("stem").isin([w[:STEM] for w in INSULTS])).collect():
            for w in INSULTS:
                if w[:STEM] == r["stem"]:
                    fixed[w] = [int(r["t"]), int(r["n"])]
        # A fixed stem counts as seen in three rows, nine tenths of them toxic.
        weights = {w: PRIOR if not m else math.log((k + 2.7) / (m - k + 0.3)) - base for w, (k, m) in fixed.items()}
        odds = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)) - F.lit(base)
        top = stems.where((F.col("t") >= least) & (F.col("t") >= self.precision * F.col("n"))).withColumn("w", odds)
        weights |= {r["stem"]: float(r["w"]) for r in top.orderBy(F.desc("w"), "stem").limit(self.stems).collect()}
        self.lexicon = Lexicon({k: w for k, w in weights.items() if w > 0})
        held = _with_features(train, self.lexicon, "y int").toPandas()  # `sample` rows of a few numbers
        self.weights = _rising(np.stack(held["f"].to_numpy()), held["y"].to_numpy(float))
        return self

    def _scorer(self):
        lexicon, weights = self.lexicon, self.weights

        def of(batch: pa.RecordBatch) -> np.ndarray:
            x = _feature_rows(lexicon, textkit.text_column(batch, "text"))
            return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))

        return of

    def keep(self, docs: DataFrame, below: float = 0.5) -> DataFrame:
        """The rows of ``docs``, with all columns, that score under ``below``."""
        of = self._scorer()

        def batches(batches):
            textkit.forget()
            for batch in batches:
                yield batch.filter(pa.array(of(batch) < below))

        return docs.mapInArrow(batches, docs.schema)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score in 0..1, one row per input row; null and empty texts score as texts without a match."""
        of = self._scorer()

        def batches(batches):
            for batch in batches:
                p = of(batch)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return narrow.mapInArrow(batches, "doc_id long, score double")


def _with_features(rows: DataFrame, lexicon: Lexicon, kept: str) -> DataFrame:
    name = kept.split()[0]

    def batches(batches):
        for batch in batches:
            x = _feature_rows(lexicon, textkit.text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(list(x), pa.list_(pa.float64()))], names=[name, "f"])

    return rows.mapInArrow(batches, f"{kept}, f array<double>")


def held_out(column: str = "doc_id") -> F.Column:
    """The fold that labels are never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityGrammar | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, repeated ones too; a null id belongs to the training fold
    and has no label."""
    model = (model or ToxicityGrammar()).fit(docs, labels.where(~held_out()))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
