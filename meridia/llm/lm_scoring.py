"""Stupid-backoff language-model scores, computed relationally.

Every text is scored by the pairs and trigrams of all other texts: c(u v w) and c(u v) count the corpus less the text's own;
c(w) counts words over the whole corpus, N of them.
S(w | u v) = c(u v w) / c(u v) if c(u v w) >= ``least``, else ``alpha`` S(w | v); S(w | v) = c(v w) / c(v) if
c(v w) >= ``least``, else ``alpha`` S(w); S(w) = c(w) / N.  A text's first word has S(w), its second
S(w | v); its score is the sum of log S.

Relations and their partitioning:

* grams (document, u, v, w, times): every trigram of every text, by the hash of u v.  In that partition they are counted,
  which gives c(u v w) and, as every pair is the start of one trigram or ends its text, c(u v); the count tables are joined
  to the grams there, and hits are summed per document.
* pairs (u v, count): the table of c(u v) counted twice or more, by the hash of u v, and misses (document, v, w, times), by
  the hash of v w, which meet it and are summed.
* words (w, count), by the hash of w.  The ``frequent`` most frequent words (a fixed bound) are broadcast; grams name them by
  rank.  What needs the count of another word is sent to that word's partition.
* sums (document, log score, words backed off), by document, added up.

Rows are packed: one binary row holds all grams that a slice of texts sends to a partition, counted per document before
the shuffle, in compressed planes.  A partition's grams stay packed while they are counted and are read again, one
row at a time, to be scored, so its memory grows with its distinct grams and not with a pair that everyone uses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import textkit
from meridia.llm.support import materialize

U64 = np.uint64
ROW = "bucket int, kind int, blob binary"
_RARE, _END = 0xFFFFFF, 0xFFFFFE  # codes of a word that isn't frequent, and of a text's end
_MUL = U64(0xFF51AFD7ED558CCD)
_AT_ONCE = 6 << 20  # packed grams of a partition that are counted and scored in one go
_GATHERED = 600_000  # sums, waiting words and misses that a task holds before they leave
# Kinds of rows: counts, grams, misses, second words, words that wait for their count, first words, sums, documents.
_TABLE, _GRAMS, _MISS, _SECOND, _COUNTED, _FIRST, _SUMS, _WORDS = range(8)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["bucket", "kind", "blob"])


def _planes(a: np.ndarray) -> list[bytes]:
    """Bytes of equal weight together, which compress better."""
    return [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, j]).tobytes() for j in range(a.itemsize)]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of any lengths, compressed: their number, kinds and lengths, then planes."""
    kinds = "".join(c.dtype.char for c in columns).encode()
    head = bytes([len(kinds)]) + kinds + np.array([len(c) for c in columns], np.int64).tobytes()
    raw = head + b"".join(b"".join(_planes(c)) for c in columns)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob) -> list[np.ndarray]:
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=size, codec="zstd", asbytes=True)
    k = raw[0]
    kinds, lens = raw[1 : 1 + k].decode(), np.frombuffer(raw, np.int64, k, 1 + k)
    at, out = 1 + k + 8 * k, []
    for kind, n in zip(kinds, lens.tolist()):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _split(bucket: np.ndarray):
    """(bucket, indices) of each bucket present."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), part


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return textkit.mix(a * _MUL + b)


def _own(key: np.ndarray, row: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each item's key occurs in its own row, and whether it is the first there; only items of ``maybe`` can
    occur twice."""
    times, first = np.ones(len(key), np.uint32), np.ones(len(key), bool)
    i = np.flatnonzero(maybe)
    _, one, at, n = np.unique(textkit.mix(key[i] ^ textkit.mix(row[i].astype(U64), 3)), return_index=True, return_inverse=True, return_counts=True)
    times[i] = n[at]
    first[i] = False
    first[i[one]] = True
    return times, first


class _Counts:
    """Keys with sums, merged as they come."""

    def __init__(self):
        self.keys, self.sums, self.held, self.size = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.held.append((keys, times.astype(np.int64)))
        self.size += len(keys)
        if self.size > 1_000_000 + len(self.keys):
            self.settle()

    def settle(self) -> _Counts:
        keys, sums = map(np.concatenate, zip((self.keys, self.sums), *self.held))
        self.keys, at = np.unique(keys, return_inverse=True)
        self.sums, self.held, self.size = np.bincount(at, sums, len(self.keys)).astype(np.int64), [], 0
        return self

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.sums[at], 0)


class _Top:
    """The most frequent words by rank: hashes, counts, and an open-addressed table from hash to rank."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.lexsort((hashes, -counts))
        self.hashes, self.counts, self.slots = hashes[order], counts[order], None

    def __getstate__(self):
        return {"hashes": self.hashes, "counts": self.counts, "slots": None}

    def _table(self) -> None:
        self.bits = max(4, (2 * len(self.hashes)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(self.hashes), dtype=np.int32)
        at = (self.hashes >> U64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def code(self, h: np.ndarray) -> np.ndarray:
        if self.slots is None:
            self._table()
        out, left = np.full(len(h), _RARE, np.int32), np.arange(len(h))
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        while len(left):
            found = self.slots[at]
            hit = found >= 0
            hit[hit] = self.hashes[found[hit]] == h[left[hit]]
            out[left[hit]] = found[hit]
            on = (found >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def hash(self, code: np.ndarray, rare: np.ndarray) -> np.ndarray:
        known = self.hashes[np.minimum(code, len(self.hashes) - 1)] if len(self.hashes) else np.zeros(len(code), U64)
        known[code == _RARE] = rare
        return known


def _codes(code: np.ndarray) -> list[np.ndarray]:
    return [((code >> s) & 0xFF).astype(np.uint8) for s in (0, 8, 16)]


def _decoded(planes) -> np.ndarray:
    return sum(p.astype(np.int32) << (8 * j) for j, p in enumerate(planes))


class _Gatherer:
    """What a task's partitions send on, gathered so that it leaves in few rows: sums per document, added up first, words
    that wait for their count, and misses."""

    def __init__(self, parts: int, buckets: int = 1):
        self.parts, self.buckets, self.held, self.waits, self.misses, self.size = parts, buckets, [], [], [], 0

    def add(self, doc, value, backed, single) -> None:
        docs, at = np.unique(doc, return_inverse=True)
        self.held.append((docs, *(np.bincount(at, x, len(docs)) for x in (value, backed, single))))
        self.size += len(docs)

    def wait(self, word, doc, weight) -> None:
        self.waits.append((word, doc, weight.astype(np.float32)))
        self.size += len(word)

    def miss(self, *columns) -> None:
        self.misses.append(columns)
        self.size += len(columns[0])

    def leave(self, least: int = 1):
        if self.size < least:
            return
        lot = _partials(*map(np.concatenate, zip(*self.held)), self.parts) if self.held else []
        if self.waits:
            w, d, x = map(np.concatenate, zip(*self.waits))
            lot += [(b, _COUNTED, pack(w[p], np.diff(d[p], prepend=0), x[p])) for b, p in _split((w % U64(self.parts)).astype(np.int64))]
        if self.misses:
            columns = list(map(np.concatenate, zip(*self.misses)))
            after = (_pair(columns[2], columns[3]) % U64(self.buckets)).astype(np.int64)
            lot += [(b, _MISS, _missed(*(c[p] for c in columns))) for b, p in _split(after)]
        self.held, self.waits, self.misses, self.size = [], [], [], 0
        for at in range(0, len(lot), 2000):
            yield _rows(lot[at : at + 2000])
        textkit.trim()


def _partials(doc, value, backed, single, buckets: int) -> list[tuple[int, int, bytes]]:
    docs, at = np.unique(doc, return_inverse=True)
    sums, counts = np.bincount(at, value, len(docs)), [np.bincount(at, x, len(docs)).astype(np.uint32) for x in (backed, single)]
    return [(b, _SUMS, pack(np.diff(docs[p], prepend=0), sums[p], *(c[p] for c in counts))) for b, p in _split(docs % buckets)]


class StupidBackoff:
    """``order``: 3, or 2 for a model of pairs.  ``least``: how often the other texts hold a gram that is used.
    ``gram_rows``: grams of a partition, on average; ``slice_bytes``: text counted together before the shuffle."""

    def __init__(self, order: int = 3, alpha: float = 0.4, least: int = 1, frequent: int = 1_000_000, gram_rows: int = 500_000, slice_bytes: int = 4 << 20):
        if order not in (2, 3) or least < 1 or not 0 < alpha <= 1 or not 0 <= frequent < _END:
            raise ValueError("order is 2 or 3, least 1 or more, alpha in (0, 1], frequent under 16 million")
        self.order, self.alpha, self.least, self.frequent, self.gram_rows, self.slice_bytes = order, alpha, least, frequent, gram_rows, slice_bytes

    @staticmethod
    def _slices(batches, slice_bytes: int):
        """(ids, whether they are known, word hashes, row of each word) of runs of whole rows."""
        for batch in batches:
            column, ids = textkit.text_column(batch, "text"), batch.column("doc_id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for lo, hi, _, _ in textkit.chunks(column, slice_bytes):
                hashes, rows = [], []
                for a, b, buf, offs in textkit.chunks(column.slice(lo, hi - lo)):
                    starts, ends, first = textkit.words(buf, offs)
                    hashes.append(textkit.span_hash(textkit.prefix_sums(buf), starts, ends))
                    rows.append((textkit.row_of(first) + a).astype(np.int32))
                yield ids[lo:hi], known[lo:hi], np.concatenate(hashes), np.concatenate(rows)

    def _words(self, buckets: int):
        def batches(batches):
            for _, _, h, _ in self._slices(batches, 2 * self.slice_bytes):
                words, counts = np.unique(h, return_counts=True)
                yield _rows([(b, _WORDS, pack(words[p], counts[p].astype(np.uint32))) for b, p in _split((words % U64(buckets)).astype(np.int64))])
                del words, counts
                textkit.trim()

        return batches

    @staticmethod
    def _count(batches):
        for group in textkit.sorted_groups(batches, ["bucket"]):
            found = _Counts()
            for x in group.column("blob"):
                found.add(*unpack(x.as_buffer()))
            found.settle()
            yield _rows([(group.column("bucket")[0].as_py(), _TABLE, pack(found.keys, found.sums))])

    def _top(self, words: DataFrame) -> _Top:
        """All words above a cutoff that ``frequent`` words pass at most."""
        rows = words.mapInArrow(_word_rows, "h long, c long")
        passed, cutoff = 0, None
        for r in rows.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():  # one row per distinct count
            passed += r["count"]
            if passed > self.frequent:
                break
            cutoff = r["c"]
        got = rows.where(F.col("c") >= (cutoff if cutoff is not None else 1 << 62)).toArrow()
        return _Top(got.column("h").to_numpy().view(U64), got.column("c").to_numpy())

    def _grams(self, buckets: int, parts: int, top: _Top, total: float):
        """Grams by the hash of their pair; a row of every document with its words and its first word's score."""

        def batches(batches):
            for ids, known, h, row in self._slices(batches, self.slice_bytes):
                lot: list[tuple[int, int, bytes]] = []
                code, n = top.code(h), len(h)
                own_word, _ = _own(h, row, np.ones(n, bool))
                n_words = np.bincount(row, minlength=len(ids))
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.zeros(0, np.int64)
                base = np.zeros(len(ids))
                near = head[code[head] != _RARE]
                base[row[near]] = np.log(top.counts[code[near]] / total) if len(near) else 0.0
                scored = np.flatnonzero(known)
                for b, p in _split(ids[scored] % parts):
                    p = scored[p]
                    lot.append((b, _WORDS, pack(ids[p], base[p], n_words[p])))
                late = head[(code[head] == _RARE) & known[row[head]]]
                for b, p in _split((h[late] % U64(parts)).astype(np.int64)):
                    p = late[p]
                    lot.append((b, _FIRST, pack(h[p], np.diff(ids[row[p]], prepend=0), np.ones(len(p), np.float32))))
                # Every pair starts one gram: with the word after it, or with the end of its text.
                at = (np.flatnonzero(row[:-1] == row[1:]) if n else np.zeros(0)).astype(np.int32)
                pair, r, third = _pair(h[at], h[at + 1]), row[at], np.minimum(at + 2, n - 1)
                own_pair, _ = _own(pair, r, (own_word[at] > 1) & (own_word[at + 1] > 1))
                more = np.zeros(len(at), bool)
                more[:-1] = r[:-1] == r[1:]
                last = np.where(more, code[third], np.int32(_END))
                own_after = np.where(more, np.append(own_pair[1:], own_pair[:1]), np.uint32(0))  # of the pair v w
                gram = textkit.mix(pair * _MUL + np.where(more, h[third], U64(0)), 5) + more.astype(U64)
                times, first = _own(gram, r, (own_pair > 1) & (~more | (own_after > 1)))
                place, first = (pair % U64(buckets)).astype(np.int32), np.flatnonzero(first).astype(np.int32)
                del pair, gram
                textkit.trim()
                for b, p in _split(place[first]):
                    p = first[p]
                    i = at[p]
                    lot.append((b, _GRAMS, self._packed(ids, known, r[p], h, [code[i], code[i + 1], last[p]], [i, i + 1, third[p]], [times[p], own_pair[p], own_after[p]])))
                start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]) & known[r]) if len(at) else np.zeros(0, np.int64)
                for b, p in _split(place[start]):
                    p = start[p]
                    i = at[p]
                    lot.append((b, _SECOND, _missed(code[i], code[i + 1], h[i], h[i + 1], ids[r[p]], np.ones(len(p), np.uint32), own_pair[p])))
                for k in range(0, len(lot), 2000):
                    yield _rows(lot[k : k + 2000])
                del lot
                textkit.trim()

        return batches

    @staticmethod
    def _packed(ids, known, row, h, codes, at, own) -> bytes:
        new = np.concatenate([[True], row[1:] != row[:-1]])  # rows ascend
        docs, local = row[new], np.cumsum(new) - 1
        rare = [h[i][c == _RARE] for c, i in zip(codes, at)]
        return pack(np.diff(ids[docs], prepend=0), known[docs].astype(np.uint8), np.diff(local, prepend=0).astype(np.uint32), *(p for c in codes for p in _codes(c)), *(o.astype(np.uint32) for o in own), *rare)

    @staticmethod
    def _read(blob, top: _Top):
        """(ids, known, pair, gram, whether a word follows, codes of v and w, hashes of v and w, own counts)."""
        ids, known, local, *rest = unpack(blob)
        ids, local = np.cumsum(ids), np.cumsum(local.astype(np.int64))
        codes = [_decoded(rest[j : j + 3]) for j in (0, 3, 6)]
        own, rare = rest[9:12], rest[12:]
        u, v, w = (top.hash(c, x) for c, x in zip(codes, rare))
        pair, more = _pair(u, v), codes[2] != _END
        w[~more] = 0
        gram = textkit.mix(pair * _MUL + w, 5) + more.astype(U64)
        return ids[local], known[local].astype(bool), pair, gram, more, codes[1:], (v, w), own

    def _meet(self, buckets: int, parts: int, top: _Top):
        """Counts a partition's grams, joins them to the counts, sums hits and sends misses on; keeps c(u v)."""

        def counted(blobs):
            """(what :meth:`_read` gives, c(u v w), c(u v)) blob by blob, or of a common partition at once; then the pairs."""
            if sum(len(b) for b in blobs) <= _AT_ONCE:
                read = self._join([self._read(b, top) for b in blobs])
                _, at = np.unique(read[3], return_inverse=True)
                grams = np.bincount(at, read[7][0])[at]
                keys, at = np.unique(read[2], return_inverse=True)
                sums = np.bincount(at, read[7][0])
                yield read, grams, sums[at]
                yield keys, sums.astype(np.int64)
                return
            pairs, grams = _Counts(), _Counts()
            for blob in blobs:
                read = self._read(blob, top)
                pairs.add(read[2], read[7][0])
                grams.add(read[3], read[7][0])
            pairs.settle(), grams.settle()
            for blob in blobs:
                read = self._read(blob, top)
                yield read, grams.of(read[3]), pairs.of(read[2])
            yield pairs.keys, pairs.sums

        def batches(batches):
            out, drop = _Gatherer(parts, buckets), self.order == 3
            for group in textkit.sorted_groups(batches, ["bucket", "kind"]):
                if group.column("kind")[0].as_py() != _GRAMS:
                    yield from group.combine_chunks().to_batches()
                    continue
                for found in counted([x.as_buffer() for x in group.column("blob")]):
                    if len(found) == 2:  # the pairs, last
                        keys, sums = found
                        often = sums > self.least
                        yield _rows([(group.column("bucket")[0].as_py(), _TABLE, pack(keys[often], sums[often]))])
                        continue
                    (doc, known, _, _, more, (cv, cw), (v, w), (times, own_uv, own_vw)), c_uvw, c_uv = found
                    others, asked = c_uvw - times, more & known
                    hit = asked & (others >= self.least) & drop
                    miss, hit = np.flatnonzero(asked & ~hit), np.flatnonzero(hit)
                    value = times[hit] * np.log(others[hit] / (c_uv[hit] - own_uv[hit]))
                    out.add(
                        np.r_[doc[hit], doc[miss]], np.r_[value, times[miss] * (np.log(self.alpha) * drop)],
                        np.r_[np.zeros(len(hit)), times[miss] * float(drop)], np.zeros(len(hit) + len(miss)),
                    )
                    out.miss(cv[miss], cw[miss], v[miss], w[miss], doc[miss], times[miss], own_vw[miss])
                    yield from out.leave(_GATHERED)
            yield from out.leave()

        return batches

    @staticmethod
    def _join(reads):
        one = list(zip(*reads))
        flat = [np.concatenate(c) for c in one[:5]]
        return (*flat, *([np.concatenate(c) for c in zip(*column)] for column in one[5:]))

    def _second(self, parts: int, top: _Top, total: float):
        """Misses and second words against the table of pairs."""

        def batches(batches):
            out = _Gatherer(parts)
            table, home = _Counts(), None
            for group in textkit.sorted_groups(batches, ["bucket", "kind"]):
                bucket, kind = group.column("bucket")[0].as_py(), group.column("kind")[0].as_py()
                if bucket != home:
                    table, home = _Counts(), bucket
                if kind == _TABLE:
                    table.keys, table.sums = unpack(group.column("blob")[0].as_buffer())
                    continue
                for x in group.column("blob"):
                    pair, cv, cw, v, w, doc, times, own_vw = _unmissed(x.as_buffer(), top)
                    others = table.of(pair) - own_vw.astype(np.int64)
                    hit = others >= self.least
                    value = np.where(hit, np.log(np.maximum(1, others)), np.log(self.alpha) - np.log(total)) * times
                    look, word = np.where(hit, cv, cw), np.where(hit, v, w)
                    sign = np.where(hit, -1.0, 1.0) * times
                    near = look != _RARE
                    value[near] += sign[near] * np.log(top.counts[look[near]]) if near.any() else 0.0
                    # A miss of the longer gram is counted already; a second word's is counted here.
                    out.add(doc, value, (~hit * times) if kind == _SECOND or self.order == 2 else np.zeros(len(doc)), ~hit * times)
                    far = np.flatnonzero(~near)
                    out.wait(word[far], doc[far], sign[far])
                    yield from out.leave(_GATHERED)
            yield from out.leave()

        return batches

    @staticmethod
    def _late(parts: int, total: float):
        """Word counts against what waits for them."""

        def batches(batches):
            out = _Gatherer(parts)
            table, home = _Counts(), None
            for group in textkit.sorted_groups(batches, ["bucket", "kind"]):
                bucket, kind = group.column("bucket")[0].as_py(), group.column("kind")[0].as_py()
                if bucket != home:
                    table, home = _Counts(), bucket
                if kind == _TABLE:
                    table.keys, table.sums = unpack(group.column("blob")[0].as_buffer())
                    continue
                for x in group.column("blob"):
                    word, doc, weight = unpack(x.as_buffer())
                    value = weight * np.log(table.of(word))
                    if kind == _FIRST:
                        value = value - np.log(total)
                    out.add(np.cumsum(doc), value, np.zeros(len(doc)), np.zeros(len(doc)))
                    yield from out.leave(_GATHERED)
            yield from out.leave()

        return batches

    @staticmethod
    def _sum(batches):
        for group in textkit.sorted_groups(batches, ["bucket"]):
            doc, value, n, backed, single = [], [], [], [], []
            for kind, x in zip(group.column("kind").to_pylist(), group.column("blob")):
                if kind == _WORDS:
                    d, v, w = unpack(x.as_buffer())
                    k = s = np.zeros(len(d))
                else:
                    d, v, k, s = unpack(x.as_buffer())
                    d, w = np.cumsum(d), np.zeros(len(d))
                for o, a in zip((doc, value, n, backed, single), (d, v, w, k, s)):
                    o.append(a)
            doc, value, n, backed, single = map(np.concatenate, (doc, value, n, backed, single))
            docs, at = np.unique(doc, return_inverse=True)
            arrays = [pa.array(docs), *(pa.array(np.bincount(at, x).astype(np.int64)) for x in (n, backed, single)), pa.array(np.bincount(at, value))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_backoff", "n_unigram", "log_score"])

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, n_backoff (words scored below the full order), n_unigram (of those by words alone), log_score,
        mean_log_score: one row per id.

        Null, empty and wordless texts score 0 with a null mean.  Rows that repeat an id are texts of their own, whose words
        and scores are added up.  Rows with a null id are counted in the model but have no row.
        """
        spark = docs.sparkSession
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        deal = lambda df, *by: df.repartition("bucket").sortWithinPartitions(*by)
        words = materialize(deal(texts.mapInArrow(self._words(parts), ROW), "bucket").mapInArrow(self._count, ROW))
        n = int(words.mapInArrow(_totals, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        total, buckets = float(n) or 1.0, max(parts, -(-n // self.gram_rows))
        top = self._top(words)
        met = materialize(deal(texts.mapInArrow(self._grams(buckets, parts, top, total), ROW), "bucket", "kind").mapInArrow(self._meet(buckets, parts, top), ROW))
        of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
        second = materialize(deal(of(met, _TABLE, _MISS, _SECOND), "bucket", "kind").mapInArrow(self._second(parts, top, total), ROW))
        late = deal(words.union(of(met, _COUNTED, _FIRST)).union(of(second, _COUNTED)), "bucket", "kind").mapInArrow(self._late(parts, total), ROW)
        rows = deal(of(met, _SUMS, _WORDS).union(of(second, _SUMS)).union(late), "bucket")
        sums = rows.mapInArrow(self._sum, "doc_id long, n_words long, n_backoff long, n_unigram long, log_score double")
        return sums.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def _missed(cv, cw, v, w, doc, times, *own) -> bytes:
    rare = v[cv == _RARE], w[cw == _RARE]
    return pack(np.diff(doc, prepend=0), *_codes(cv), *_codes(cw), *(o.astype(np.uint32) for o in (times, *own)), *rare)


def _unmissed(blob, top: _Top):
    doc, *rest = unpack(blob)
    cv, cw = _decoded(rest[:3]), _decoded(rest[3:6])
    times, *own = rest[6:8]
    v, w = top.hash(cv, rest[8]), top.hash(cw, rest[9])
    return _pair(v, w), cv, cw, v, w, np.cumsum(doc), times.astype(np.float64), *own


def _word_rows(batches):
    for batch in batches:
        for blob in batch.column("blob"):
            h, c = unpack(blob.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])


def _totals(batches):
    for batch in batches:
        n = [int(unpack(x.as_buffer())[1].sum()) for x in batch.column("blob")]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])
