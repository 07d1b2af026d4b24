"""Quality rules with risk-controlled thresholds.

Every rule compares one feature of a text with a cutoff.  Per stratum (length class) the calibration fold of the labelled
rows proposes a chain: each rule's cutoff is the quantile of good texts that best separates, and rules follow one another
by their gain, each only if it rejects more poor than good texts that the rules before it let through.  The chain is fixed
before the holdout is looked at.  Then the holdout tests its prefixes one by one: the exact
(Clopper-Pearson) upper bound of the share of good texts that the prefix's rules reject together must be
at or under ``alpha``, at confidence ``1 - delta / strata``; the first prefix that fails ends the chain.  Testing in a fixed
order up to the first failure needs no correction inside a stratum, and Bonferroni's corrects over the strata:
with probability ``1 - delta`` the bounds of all strata hold at once.  A stratum with too few good rows to prove the bound
gets no rule.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import textkit
from meridia.llm.support import materialize

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_bytes", "n_end_marks", "n_distinct_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + EXTRA)

#: name: (numerator, denominator, +1 when high values are bad, -1 when low ones are)
RULES = {
    "symbols_per_char": ("n_symbols", "word_chars", 1),
    "dup_line_share": ("n_dup_lines", "n_lines", 1),
    "repeat_share": ("n_repeat_words", "n_words", 1),
    "upper_share": ("n_upper", "word_chars", 1),
    "digit_share": ("n_digits", "word_chars", 1),
    "distinct_share_low": ("n_distinct_words", "n_words", -1),
    "word_length_high": ("word_chars", "n_words", 1),
    "word_length_low": ("word_chars", "n_words", -1),
    "end_marks_high": ("n_end_marks", "n_words", 1),
    "end_marks_low": ("n_end_marks", "n_words", -1),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def _span_counts(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return textkit.per_row_sum(mask, offs)


def _firsts(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where (row, key) is met for the first time; rows ascend."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    out = np.zeros(len(order), bool)
    out[order[new]] = True  # lexsort is stable, so the first of a run is the earliest
    return out


def _repeated(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where (row, key) occurs twice or more."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    out = np.zeros(len(order), bool)
    out[order] = same[1:] | same[:-1]
    return out


def chunk_features(buf: np.ndarray, offs: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    n_rows = len(offs) - 1
    starts, ends, first = textkit.words(buf, offs)
    acc = textkit.prefix_sums(buf)
    n_words = np.diff(first)
    row = textkit.row_of(first)
    h = textkit.span_hash(acc, starts, ends)
    # Windows of eight words: those found twice in a row mark all words they cover.
    covered = np.zeros(len(h) + 1, np.int64)
    rolled = textkit.rolling(h, window)
    if len(rolled):
        at = np.flatnonzero(row[: len(rolled)] == row[window - 1 :])
        hit = at[_repeated(row[at], rolled[at])]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
    covered = np.cumsum(covered)[:-1] > 0
    # Lines: split at \n inside each row; those with a word count.
    cut = np.flatnonzero(buf == 10)
    cut_row = np.searchsorted(offs, cut, "right") - 1
    line_start = np.concatenate([offs[:-1], cut + 1])
    line_row = np.concatenate([np.arange(n_rows), cut_row])
    order = np.lexsort((line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_end = np.empty_like(line_start)
    line_end[:-1] = np.where(line_row[1:] == line_row[:-1], line_start[1:] - 1, offs[line_row[:-1] + 1])
    line_end[-1:] = offs[line_row[-1:] + 1]
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    ls, le, lr = line_start[worded], line_end[worded], line_row[worded]
    dup = ~_firsts(lr, textkit.span_hash(acc, ls, le))
    inside = ~textkit.SPACE[buf]
    out = {
        "n_words": n_words,
        "word_chars": _span_counts(inside & ((buf & 0xC0) != 0x80), offs),
        "n_symbols": _span_counts(_SYMBOL[buf], offs),
        "n_dup_lines": np.bincount(lr[dup], minlength=n_rows),
        "n_repeat_words": np.bincount(row[covered], minlength=n_rows),
        "n_lines": np.bincount(lr, minlength=n_rows),
        "n_upper": _span_counts((buf >= 65) & (buf <= 90), offs),
        "n_digits": _span_counts((buf >= 48) & (buf <= 57), offs),
        "n_bytes": np.diff(offs),
        "n_end_marks": np.bincount(row[_END[buf[ends - 1]]], minlength=n_rows) if len(ends) else np.zeros(n_rows),
        "n_distinct_words": np.bincount(row[_firsts(row, h)], minlength=n_rows),
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def _feature_batches(batches):
    for batch in batches:
        got = [chunk_features(buf, offs) for _, _, buf, offs in textkit.chunks(textkit.text_column(batch, "text"))]
        arrays = [batch.column(batch.schema.get_field_index("doc_id"))]
        for name in COUNTS + EXTRA:
            arrays.append(pa.array(np.concatenate([g[name] for g in got]) if got else np.zeros(0, np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS, *EXTRA])


def features(docs: DataFrame) -> DataFrame:
    """One row of counts per input row; null and empty texts have zeros."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_feature_batches, SCHEMA)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p with P(X <= k | n, p) >= delta."""
    if n == 0 or k >= n:
        return 1.0

    i = np.arange(1, k + 1)
    ways = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i))])
    i = np.arange(k + 1)

    def below(p: float) -> float:
        if p <= 0:
            return 1.0
        if p >= 1:
            return 0.0
        logs = ways + i * math.log(p) + (n - i) * math.log1p(-p)
        top = float(logs.max())
        return math.exp(top) * float(np.exp(logs - top).sum())

    lo, hi = k / n, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) > delta else (lo, mid)
    return hi


STRATA = ("short", "middle", "long")


def at_quantile(q: float, n: int) -> int:
    """Index of a quantile among ``n`` sorted values: the higher one where it falls between two."""
    return math.ceil(q * (n - 1))


def proposed(cuts: dict[str, list[float]], above: dict[str, list[tuple[int, int]]], n_clean: int, n_poor: int) -> list[tuple[str, float]]:
    """(rule, cutoff) by gain, from each cutoff's counts of (clean, poor) rows above it."""
    out = []
    for rule, counts in above.items():
        gain = [poor / n_poor - 10 * (clean / n_clean) for clean, poor in counts] if n_clean and n_poor else []
        best = int(np.argmax(gain)) if gain else 0
        if gain and gain[best] > 0:
            out.append((gain[best], rule, cuts[rule][best]))
    return [(rule, c) for _, rule, c in sorted(out, key=lambda p: (-p[0], p[1]))]


def pruned(rules: list[tuple[str, float]], masks: np.ndarray, good: np.ndarray, n: np.ndarray) -> list[tuple[str, float]]:
    """Those rules that reject more poor than good rows which the kept ones before let through; bit i of a mask: rule i rejects."""
    out, left = [], np.ones(len(masks), bool)
    for i, rule in enumerate(rules):
        new = left & (masks >> i & 1 > 0)
        if n[new & ~good].sum() > n[new & good].sum():
            out.append(rule)
            left &= ~new
    return out


def masked(rules: list[tuple[str, float]], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for i, (rule, c) in enumerate(rules):
        out |= (x[rule] > c).astype(np.int64) << i
    return out


def chain(x: dict[str, np.ndarray], good: np.ndarray, quantiles) -> list[tuple[str, float]]:
    """(rule, cutoff) in order, from calibration rows alone; ``x`` holds each rule's feature, high values bad.  ``fit`` comes
    to the same from counts over a table."""
    cuts, above, clean = {}, {}, int(good.sum())
    for rule, v in x.items():
        ordered = np.sort(v[good])
        cuts[rule] = [float(ordered[at_quantile(q, clean)]) for q in quantiles] if clean else []
        above[rule] = [(int((v[good] > c).sum()), int((v[~good] > c).sum())) for c in cuts[rule]]
    rules = proposed(cuts, above, clean, len(good) - clean)
    return pruned(rules, masked(rules, x, len(good)), good, np.ones(len(good), np.int64))


def proven(rules: list[tuple[str, float]], rejected: list[int], n: int, alpha: float, level: float) -> tuple[list[tuple[str, float]], float]:
    """The longest prefix whose every prefix holds, and its bound; ``rejected``: of ``n`` good rows, by each prefix."""
    bound = 1.0
    for i, k in enumerate(rejected):
        now = upper_bound(k, n, level) if k <= alpha * n else 1.0  # the bound is over k / n
        if now > alpha:
            return rules[:i], bound
        bound = now
    return rules, bound


def admitted(rules: list[tuple[str, float]], x: dict[str, np.ndarray], alpha: float, level: float) -> tuple[list[tuple[str, float]], float]:
    """The longest prefix of the chain whose every prefix holds on the holdout's good rows, and its bound."""
    n = len(next(iter(x.values()))) if x else 0
    masks = masked(rules, x, n)
    return proven(rules, [int((masks & ((2 << i) - 1) > 0).sum()) for i in range(len(rules))], n, alpha, level)


#: Bits of a double told in each pass over the rows; what a pass sends to the driver is 2^11 counts a quantile at most.
_SHIFTS = (53, 42, 31, 20, 9, 0)
_TOP = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; both zeros are one."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u & _TOP, ~u, u | _TOP)


def from_bits(key: int) -> float:
    u = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([u], np.uint64).view(np.float64)[0])


def tally(rows: DataFrame, count) -> list[tuple]:
    """Equal tuples that ``count`` tells of each batch, (tuples as int64 columns, times), summed over all rows."""

    def batches(batches):
        for batch in batches:
            keys, n = count(batch)
            cells = np.ascontiguousarray(keys, np.int64)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * cells.shape[1]), len(cells), [None, pa.py_buffer(cells)]).cast(pa.binary()), pa.array(n, pa.int64())], names=["k", "n"])

    got = rows.mapInArrow(batches, "k binary, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return [(*np.frombuffer(r["k"], np.int64).tolist(), r["n"]) for r in got]


def _stacked(parts: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray]:
    """((constants, values, counts), ...) as rows of keys and their counts."""
    keys = [np.column_stack([*[np.full(len(v), c) for c in head], v]) for head, v, _ in parts]
    return (np.concatenate(keys), np.concatenate([n for *_, n in parts])) if parts else (np.zeros((0, width), np.int64), np.zeros(0, np.int64))


def _columns(batch: pa.RecordBatch, names) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def order_statistics(rows: DataFrame, names: list[str], quantiles) -> dict[tuple[int, int], list[float]]:
    """(group, column): the values at the quantiles, exact: their bits are told from the highest on, a pass for eleven."""
    state: dict[tuple[int, int], list[tuple[int, int]]] = {}  # of each quantile: bits told, and the rank among rows that begin so
    above = 64
    for shift in _SHIFTS:
        wanted = {k: np.array(sorted({p for p, _ in v}), np.uint64) for k, v in state.items()}

        def count(batch, shift=shift, above=above, wanted=wanted):
            group, *columns = _columns(batch, ["g", *names])
            out = []
            for g in np.unique(group).tolist():
                for j, x in enumerate(columns):
                    key = ordered_bits(x[group == g])
                    if above < 64:
                        key = key[np.isin(key >> np.uint64(above), wanted[g, j])]
                    values, n = np.unique(key >> np.uint64(shift), return_counts=True)
                    out.append(((g, j), values.view(np.int64), n))
            return _stacked(out, 3)

        counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for g, j, v, n in tally(rows, count):
            counts.setdefault((g, j), []).append((v % (1 << 64), n))
        for k, found in counts.items():
            found.sort()
            values, sums = [v for v, _ in found], np.cumsum([n for _, n in found])
            if above == 64:
                state[k] = [(0, at_quantile(q, int(sums[-1]))) for q in quantiles]
            new = []
            for prefix, rank in state[k]:
                first = bisect.bisect_left(values, prefix << (above - shift)) if above < 64 else 0
                before = int(sums[first - 1]) if first else 0
                i = int(np.searchsorted(sums, before + rank, "right"))
                new.append((values[i], before + rank - (int(sums[i - 1]) if i else 0)))
            state[k] = new
        above = shift
    return {k: [from_bits(p) for p, _ in v] for k, v in state.items()}


class RiskControlledRules:
    """``fit`` on all labelled rows, ``apply`` to all.

    ``alpha``: bound on the share of good texts that all rules of a stratum together reject; ``delta``:
    chance that any stratum breaks its bound.  Cutoffs and tests are exact: the driver gets counts, not rows.
    """

    def __init__(self, alpha=0.02, delta=0.05, quantiles=(0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 1.0)):
        self.alpha, self.delta, self.quantiles = alpha, delta, quantiles
        self.cutoffs: dict[tuple[str, str], float] = {}
        self.bounds: dict[str, float] = {}

    @staticmethod
    def stratum() -> F.Column:
        """A text property known for every row: short, middle or long by words."""
        return F.when(F.col("n_words") < 100, "short").when(F.col("n_words") < 1000, "middle").otherwise("long")

    @staticmethod
    def base_failed() -> F.Column:
        return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))

    def fit(self, feats: DataFrame, labels: DataFrame) -> RiskControlledRules:
        """Rows with a null label or id are not used; of labels that repeat an id the least counts, and of rows that repeat
        one the least by its counts, so that rows are independent; a stratum short of good rows gets no cutoff."""
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
        known = known.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
        rows = feats.where(~self.base_failed()).join(known, "doc_id")
        rows = rows.groupBy("doc_id", "good").agg(F.min(F.struct(*COUNTS, *EXTRA)).alias("f")).select("doc_id", "good", "f.*")
        group = F.element_at(F.create_map(*[F.lit(v) for i, name in enumerate(STRATA) for v in (name, i)]), self.stratum())
        fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)).cast("int")
        names = [f"x{j}" for j in range(len(RULES))]
        scores = [self.score(rule).alias(x) for rule, x in zip(RULES, names)]
        rows = materialize(rows.select(group.cast("int").alias("g"), fold.alias("hold"), (F.col("good") == 1).cast("int").alias("clean"), *scores))
        calibration = rows.where("hold = 0")
        told = order_statistics(calibration.where("clean = 1"), names, self.quantiles)
        cuts = {g: {rule: told[g, j] for j, rule in enumerate(RULES)} for g in {g for g, _ in told}}

        def above(batch):
            group, clean, *columns = _columns(batch, ["g", "clean", *names])
            out = []
            for g in np.unique(group).tolist():
                for c in (0, 1):
                    part = (group == g) & (clean == c)
                    out.append(((g, c, -1), np.zeros(1, np.int64), np.array([part.sum()])))
                    for j, (rule, x) in enumerate(zip(RULES, columns) if g in cuts else ()):
                        edges = np.array(cuts[g][rule])
                        out.append(((g, c, j), np.arange(len(edges)), (x[part][:, None] > edges[None, :]).sum(axis=0)))
            return _stacked(out, 4)

        over = {tuple(k): n for *k, n in tally(calibration, above)}
        rules = {}
        for g, of in cuts.items():
            pairs = {rule: [(over.get((g, 1, j, i), 0), over.get((g, 0, j, i), 0)) for i in range(len(of[rule]))] for j, rule in enumerate(RULES)}
            rules[g] = proposed(of, pairs, over.get((g, 1, -1, 0), 0), over.get((g, 0, -1, 0), 0))

        def patterns(batch):
            group, hold, clean, *columns = _columns(batch, ["g", "hold", "clean", *names])
            masks = np.zeros(len(group), np.int64)
            for g, own in rules.items():
                part = group == g
                masks[part] = masked(own, {rule: x[part] for rule, x in zip(RULES, columns)}, int(part.sum()))
            return np.unique(np.column_stack([group, hold, clean, masks]).astype(np.int64), axis=0, return_counts=True)

        counted = np.array(tally(rows, patterns), np.int64).reshape(-1, 5)
        self.cutoffs, self.bounds = {}, {}
        for g, own in sorted(rules.items()):
            clean, hold, masks, n = ((counted[counted[:, 0] == g])[:, i] for i in (2, 1, 3, 4))
            kept = pruned(own, masks[hold == 0], clean[hold == 0] == 1, n[hold == 0])
            tested, cover, rejected = (hold == 1) & (clean == 1), 0, []
            for rule in kept:
                cover |= 1 << own.index(rule)
                rejected.append(int(n[tested & (masks & cover > 0)].sum()))
            kept, bound = proven(kept, rejected, int(n[tested].sum()), self.alpha, self.delta / len(STRATA))
            self.cutoffs |= {(STRATA[g], rule): c for rule, c in kept}
            if kept:
                self.bounds[STRATA[g]] = bound
        return self

    @staticmethod
    def score(rule: str) -> F.Column:
        num, den, sign = RULES[rule]
        return F.lit(float(sign)) * F.col(num).cast("double") / F.greatest(F.lit(1.0), F.col(den).cast("double"))

    def verdict(self) -> F.Column:
        bad = F.lit(False)
        stratum = self.stratum()
        for (name, rule), c in sorted(self.cutoffs.items()):
            bad = bad | ((stratum == name) & (self.score(rule) > F.lit(c)))
        return bad

    def apply(self, feats: DataFrame) -> DataFrame:
        failed = self.base_failed()
        return feats.select(
            "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~self.verdict()).alias("kept"), self.verdict().alias("rule_failed")
        )


def quality_rules(docs: DataFrame, labels: DataFrame, rules: RiskControlledRules | None = None) -> DataFrame:
    """doc_id, counts, base_failed, kept, rule_failed: one row per input row, repeated ids and null ids too; features are
    computed once, then kept.  Null, empty and wordless texts have zeros and fail the base filter."""
    feats = materialize(features(docs))
    return (rules or RiskControlledRules()).fit(feats, labels).apply(feats)
