"""Repeated passages by blockwise suffix sorting over a cover sample.

A byte is removed when a string of ``length`` bytes that covers it also starts in a document with a
smaller id.  Sorting every suffix of a corpus costs more than the corpus, so a cover sample is sorted and
all other suffixes are resolved by its ranks, one block (bucket of suffixes) at a time.

A cover holds, for any two equal windows of ``length`` bytes, a common shift at which both are sampled.  ``residues`` is
the difference cover {0, 1, 3, 8, 12, 18} modulo 31 of the positions in a document (6/31 of them).  ``content`` takes
from every window the position of its least ``SEED``-byte hash (1/14 of them); it groups equal windows by the sampled
seed just as well and is the default because it is what the disk holds.  Either way a block is all samples with one
seed and needs no other text.

1. Samples with equal contexts (all bytes that a window around them can reach, told apart by 64-bit hashes on top of
   the 64 bits of the seed) tie over their whole reach: one rank each, the smallest document keeps its bytes, all others
   lose them.  This happens inside each batch first, so a group of copies ships one member per batch.
2. Where one seed has several contexts, the smallest member of each goes on.  A block sorts these samples
   by the bytes to their right and to their left, with common-prefix lengths; the window that starts d
   bytes before a sample has class (left rank at depth d, right rank at depth length - d), so windows of
   all shifts are compared by ranks alone.
3. A seed with more contexts than a block may hold is split by longer prefixes, up to the window itself: its windows
   become rows, and the least document of each is one aggregation, summed up before the shuffle.  What one batch
   already knows to be such a seed is dealt by its contexts, not by the seed, so no task gets it whole.

Buckets hold about ``bucket_bytes`` of text each, whatever the size of the corpus.  Memory of a task is a small multiple
of that, of ``_TIE_BYTES``, and of the longest text (about 40 bytes a byte of it).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm import textkit
from meridia.llm.support import BROADCAST_ROWS, free_name, materialize, sized

U64 = np.uint64
_PIECE = 1 << 22
_TIE_BYTES = 8 << 20  # text whose ties are settled before the shuffle
_CUT_BYTES = 1 << 20  # text that leaves a worker at once when it is cut
_ROWS = 500  # rows of blobs that leave a worker at once: both sides hold a batch whole
_ROW = "bucket int, kind int, doc long, twin long, blob binary"
_SPANS = "kind int, doc long, twin long, blob binary"
_HOT, _SPAN, _SAMPLE, _SPREAD = 0, 1, 2, 3  # kinds of rows dealt: hot seeds, spans, samples, samples of hot seeds
_STARTS, _ASKED, _WINDOWS = 3, 2, 5  # kinds of rows after ties (and _SPAN): spans by sample, samples to compare, of hot seeds
RESIDUES = np.isin(np.arange(31), [0, 1, 3, 8, 12, 18])


def cover(buf: np.ndarray, offs: np.ndarray, length: int, seed: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions, ascending, and the hash of the seed at each."""
    reach = length - seed + 1
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    acc = textkit.prefix_sums(buf)
    end = np.repeat(offs[1:], np.diff(offs))
    if kind == "residues":
        start = np.repeat(offs[:-1], np.diff(offs))
        at = np.arange(len(buf))
        pos = np.flatnonzero(RESIDUES[(at - start) % 31] & (at + seed <= end) & (end - start >= length))
        return pos, textkit.span_hash(acc, pos, pos + seed, 3)
    at = np.arange(len(buf) - seed + 1)
    seeds = textkit.span_hash(acc, at, at + seed, 3)
    found = []
    for lo in range(0, len(seeds) - reach + 1, _PIECE):
        hi = min(len(seeds), lo + _PIECE + reach - 1)
        key = (seeds[lo:hi] & ~U64((1 << 24) - 1)) | np.arange(hi - lo, dtype=U64)
        width = 1
        while 2 * width <= reach:  # least over `width` positions, doubled
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < reach:
            key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
        start = np.arange(lo, lo + len(key))
        best = (key[start + length <= end[start]] & U64((1 << 24) - 1)).astype(np.int64) + lo
        if len(best):
            found.append(best[np.concatenate([[True], best[1:] != best[:-1]])])
    pos = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pos, seeds[pos]


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, ascending; intervals that touch unite."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([new[1:], [True]])]


def _spans(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return np.c_[starts, ends].astype(np.int64).tobytes()


def rank_breaks(block: np.ndarray, rows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` (bytes, padded) inside blocks, and each row's common prefix with the one before (-1: other block)."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    keys = padded.view(">u8").astype(U64)
    order = np.lexsort((*[keys[:, j] for j in range(keys.shape[1] - 1, -1, -1)], block))
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(lens[order[1:]], lens[order[:-1]]))
    common[block[order[1:]] != block[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def block_hits(block, left, llen, right, rlen, doc, length) -> np.ndarray:
    """(sample, d): does the window that starts d bytes before the sample also start in a smaller document?"""
    n, reach = len(block), left.shape[1] + 1
    hits = np.zeros((n, reach), bool)
    r_order, r_common = rank_breaks(block, right, rlen)
    l_order, l_common = rank_breaks(block, left, llen)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(reach):
        ok = np.flatnonzero((llen >= d) & (rlen >= length - d))
        if len(ok) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < length - d)
        l_class[l_order] = np.cumsum(l_common < d)
        key = l_class[ok] * (n + 1) + r_class[ok]
        order = np.lexsort((doc[ok], key))
        k, x = key[order], doc[ok][order]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        least = x[np.flatnonzero(first)[np.cumsum(first) - 1]]
        hits[ok[order], d] = x > least
    return hits


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "doc": pa.int64(), "twin": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[n]) for j, n in enumerate(names)], names=names)


def _runs(key: np.ndarray):
    """Index runs of equal neighbours."""
    return np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1) if len(key) else ()


class SuffixDedup:
    """``length``: bytes of a repeated string; ``sampling``: the cover, content or residues; ``bucket_bytes``: text whose
    samples make a bucket; ``crowd``: contexts of one seed that a batch sends to one bucket, and ``block``: that are
    compared in one block, beyond which the seed is split; ``bytes_limit``: most bytes of per-document spans that are
    broadcast, beyond which the join shuffles.

    Rows that repeat an id are documents of their own that don't count as smaller than each other; rows that repeat an id
    and its text lose the same bytes.  Null and empty texts have no bytes; a row with a null id keeps all of its, and
    is no source for others.
    """

    def __init__(self, length: int = 50, sampling: str = "content", bucket_bytes: int = 16 << 20, crowd: int = 256, block: int = 4096, bytes_limit: int = 32 << 20):
        if sampling not in ("content", "residues") or length < 32:
            raise ValueError("sampling is content or residues, and length 32 or more")
        self.length, self.sampling, self.bucket_bytes, self.crowd, self.block, self.bytes_limit = length, sampling, bucket_bytes, crowd, block, bytes_limit
        self.seed = length - 30 if sampling == "residues" else 24
        self.before, self.reach = length - self.seed, length - self.seed + 1

    # 1: samples, ties inside a batch, packed by bucket
    def _samples(self, buckets: int):
        length, before = self.length, self.before

        def batches(batches):
            textkit.forget()
            for batch in _slices(batches, _TIE_BYTES):
                batch = batch.filter(batch.column("doc_id").is_valid())
                batch = batch.take(pa.array(np.argsort(batch.column("doc_id").to_numpy(), kind="stable")))
                ids, twins = batch.column("doc_id").to_numpy(), batch.column("twin").to_numpy()
                found = []
                for lo, _, buf, offs in textkit.chunks(textkit.text_column(batch, "text")):
                    p, h = cover(buf, offs, length, self.seed, self.sampling)
                    if len(p):
                        row = np.searchsorted(offs, p, "right") - 1
                        a, b = np.maximum(p - before, offs[row]), np.minimum(p + length, offs[row + 1])
                        ctx = textkit.span_hash(textkit.prefix_sums(buf), a, b, 9) + (p - a).astype(U64) * U64(0x9E3779B97F4A7C15)
                        found.append((h, ctx, *(v.astype(np.int32) for v in (row + lo, p - offs[row], a - offs[row], b - offs[row]))))
                if not found:
                    continue
                seed, ctx, doc, pos, lo_b, hi_b = map(np.concatenate, zip(*found))
                del found
                order = np.lexsort((ctx, seed))  # stable; rows ascend by document already
                k, c, x = seed[order], ctx[order], ids[doc[order]]
                first = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
                tied = np.zeros(len(k), bool)
                tied[order] = x > x[np.flatnonzero(first)[np.cumsum(first) - 1]]
                rows: list[tuple] = []
                local = np.flatnonzero(tied)
                for run in _runs(doc[local]):
                    part = local[run]
                    r = doc[part[0]]
                    rows.append((int(ids[r] % buckets), _SPAN, int(ids[r]), int(twins[r]), _spans(*merge(lo_b[part].astype(np.int64), hi_b[part].astype(np.int64)))))
                by_seed = order[~tied[order]]
                k = seed[by_seed]
                new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
                many = np.diff(np.append(np.flatnonzero(new), len(k))) > self.crowd
                for h in k[new][many].tolist():
                    rows.append((h % buckets, _HOT, None, None, np.uint64(h).tobytes()))
                crowded = np.zeros(len(seed), bool)
                crowded[by_seed[many[np.cumsum(new) - 1]]] = True
                ship = np.flatnonzero(~tied).astype(np.int32)
                crowded = crowded[ship]
                del order, by_seed, k, c, x, new, first
                home = (seed[ship] % U64(buckets)).astype(np.int32)
                apart = (textkit.mix(seed[ship] ^ ctx[ship], 1) % U64(buckets)).astype(np.int32) if crowded.any() else home
                for kind, mine, bucket in ((_SAMPLE, ~crowded, home), (_SPREAD, crowded, apart)):
                    part, bucket = ship[mine], bucket[mine]
                    order = np.argsort(bucket, kind="stable")
                    part, bucket = part[order], bucket[order]
                    for run in _runs(bucket):
                        i = part[run]
                        rows.append((int(bucket[run[0]]), kind, None, None, _pack(seed[i], ctx[i], ids[doc[i]], pos[i].astype(np.int64), twins[doc[i]])))
                for at in range(0, len(rows), _ROWS):
                    yield _rows(rows[at : at + _ROWS], ["bucket", "kind", "doc", "twin", "blob"])
                del rows, seed, ctx, doc, pos, lo_b, hi_b
                textkit.trim()

        return batches

    # 2: ties over a bucket; spans to remove, and samples to compare
    def _ties(self, batches):
        names, hot, home = ["kind", "doc", "twin", "blob"], np.zeros(0, U64), None
        for group in textkit.sorted_groups(batches, ["bucket", "kind"]):
            bucket, kind = (group.column(c)[0].as_py() for c in ("bucket", "kind"))
            if bucket != home:
                hot, home = np.zeros(0, U64), bucket
            if kind == _HOT:
                hot = np.unique(np.frombuffer(b"".join(group.column("blob").to_pylist()), U64))
                continue
            if kind == _SPAN:
                yield from group.select(names).combine_chunks().to_batches()
                continue
            seed, ctx, doc, pos, twin = map(np.concatenate, zip(*[_unpack(x.as_buffer()) for x in group.column("blob")]))
            order = np.lexsort((pos, twin, doc, ctx, seed))
            seed, ctx, doc, pos, twin = seed[order], ctx[order], doc[order], pos[order], twin[order]
            new_seed = np.concatenate([[True], seed[1:] != seed[:-1]])
            new_class = new_seed | np.concatenate([[True], ctx[1:] != ctx[:-1]])
            least = doc[np.flatnonzero(new_class)[np.cumsum(new_class) - 1]]
            tied = doc > least
            again = np.concatenate([[False], ~new_class[1:] & (doc[1:] == doc[:-1]) & (twin[1:] == twin[:-1]) & (pos[1:] == pos[:-1])])
            if kind == _SPREAD:
                asked, crowded = ~tied & ~again, np.ones(len(seed), bool)
            else:
                group_id, firsts = np.cumsum(new_seed) - 1, np.flatnonzero(new_seed)
                contexts = np.bincount(group_id, new_class)[group_id]
                differ = (np.maximum.reduceat(doc, firsts) > np.minimum.reduceat(doc, firsts))[group_id]
                crowded = np.isin(seed, hot)
                asked = ~tied & ~again & ((contexts > 1) & differ | crowded)
                crowded |= np.bincount(group_id, asked)[group_id] > self.block
            rows = []
            for out, mask in ((_STARTS, tied), (_ASKED, asked & ~crowded), (_WINDOWS, asked & crowded)):
                at = np.flatnonzero(mask)
                at = at[np.lexsort((twin[at], doc[at]))]
                cut = np.concatenate([[0], np.cumsum((np.diff(doc[at]) != 0) | (np.diff(twin[at]) != 0))]) if len(at) else at
                for run in _runs(cut):
                    i = at[run]
                    rows.append((out, int(doc[i[0]]), int(twin[i[0]]), pos[i].astype(np.int64 if out == _STARTS else np.uint32).tobytes()))
            for at in range(0, len(rows), _ROWS):
                yield _rows(rows[at : at + _ROWS], names)

    # 3: contexts of the samples to compare
    def _contexts(self, batches):
        before, length = self.before, self.length
        for batch in batches:
            data, offs = textkit.as_bytes(textkit.text_column(batch, "text"))
            for i, (doc, twin, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "twin", "blob")))):
                own = data[offs[i] : offs[i + 1]]
                raw, n = np.concatenate([np.zeros(before, np.uint8), own, np.zeros(length, np.uint8)]), len(own)
                whole = np.frombuffer(blob, np.uint32).astype(np.int64)
                sums = textkit.prefix_sums(own)
                for at in range(0, len(whole), 10_000):  # a long text's samples leave in parts
                    pos = whole[at : at + 10_000]
                    text = raw[pos[:, None] + np.arange(before + length)[None, :]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(textkit.span_hash(sums, pos, pos + self.seed, 3).view(np.int64)),
                            pa.array(np.full(len(pos), doc, np.int64)),
                            pa.array(np.full(len(pos), twin, np.int64)),
                            pa.array(pos),
                            pa.array(np.minimum(pos, before).astype(np.int32)),
                            pa.array(np.minimum(n - pos, length).astype(np.int32)),
                            textkit.binary_array([t.tobytes() for t in text]),
                        ],
                        names=["seed", "doc", "twin", "pos", "llen", "rlen", "text"],
                    )
        textkit.trim()

    # 3, for hot seeds: their windows
    def _windows(self, batches):
        for batch in batches:
            data, offs = textkit.as_bytes(textkit.text_column(batch, "text"))
            for i, (doc, twin, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "twin", "blob")))):
                own = data[offs[i] : offs[i + 1]]
                sums = textkit.prefix_sums(own)
                whole = np.frombuffer(blob, np.uint32).astype(np.int64)
                for at in range(0, len(whole), 1000):
                    pos = whole[at : at + 1000]
                    start = (pos[:, None] - np.arange(self.reach)[None, :]).ravel()
                    seed = np.repeat(textkit.span_hash(sums, pos, pos + self.seed, 3), self.reach)
                    ok = (start >= 0) & (start + self.length <= len(own))
                    start, seed = start[ok], seed[ok]
                    arrays = [seed.view(np.int64), textkit.span_hash(sums, start, start + self.length, 9).view(np.int64), np.full(len(start), doc, np.int64), np.full(len(start), twin, np.int64), start]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["seed", "window", "doc", "twin", "start"])
        textkit.trim()

    def _starts(self, batches):
        for group in textkit.sorted_groups(batches, ["doc", "twin"]):
            s = np.sort(group.column("start").to_numpy())
            yield _rows([(_SPAN, group.column("doc")[0].as_py(), group.column("twin")[0].as_py(), _spans(*merge(s, s + self.length)))], ["kind", "doc", "twin", "blob"])

    def _split(self, texts: DataFrame, asked: DataFrame) -> DataFrame:
        """Spans of the windows around hot seeds that a smaller document has as well."""
        rows = self._joined(texts, asked, "inner").mapInArrow(self._windows, "seed long, window long, doc long, twin long, start long")  # worked out twice
        least = rows.groupBy("seed", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
        hits = rows.join(sized(materialize(least)), ["seed", "window"]).where("doc > least").select("doc", "twin", "start")
        return hits.repartition("doc", "twin").sortWithinPartitions("doc", "twin").mapInArrow(self._starts, _SPANS)

    # 4: one block of seeds at a time
    def _blocks(self, batches):
        held, rows = [], 0
        for group in textkit.sorted_groups(batches, ["seed"]):
            held.append(group)
            rows += len(group)
            if rows >= 20_000:
                yield from self._block(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield from self._block(pa.concat_tables(held))

    def _block(self, t: pa.Table):
        before = self.before
        seed, doc, twin, pos, llen, rlen = (t.column(c).to_numpy() for c in ("seed", "doc", "twin", "pos", "llen", "rlen"))
        text = np.frombuffer(b"".join(t.column("text").to_pylist()), np.uint8).reshape(len(t), before + self.length)
        hits = block_hits(seed, text[:, before - 1 :: -1][:, :before], llen, text[:, before:], rlen, doc, self.length)
        rows = []
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            starts = np.sort(pos[i] - np.flatnonzero(hits[i]))
            rows.append((_SPAN, int(doc[i]), int(twin[i]), _spans(*merge(starts, starts + self.length))))
        yield _rows(rows, ["kind", "doc", "twin", "blob"])

    # 5: spans per document
    def _union(self, batches):
        before, length = self.before, self.length
        rows, names = [], ["doc", "twin", "blob"]
        for group in textkit.sorted_groups(batches, ["doc", "twin"]):
            s, e = [], []
            for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist()):
                x = np.frombuffer(blob, np.int64)
                s.append(np.maximum(0, x - before) if kind == _STARTS else x[::2])
                e.append(x + length if kind == _STARTS else x[1::2])
            rows.append((group.column("doc")[0].as_py(), group.column("twin")[0].as_py(), _spans(*merge(np.concatenate(s), np.concatenate(e)))))
            if len(rows) >= 2000:
                yield _rows(rows, names)
                rows = []
        if rows:
            yield _rows(rows, names)

    def _joined(self, texts: DataFrame, blobs: DataFrame, how: str) -> DataFrame:
        """Join per-document blobs to texts: a broadcast only within row and byte bounds, else a shuffle."""
        size = blobs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("b")).first()
        small = size["n"] <= BROADCAST_ROWS and size["b"] <= self.bytes_limit
        return texts.join(F.broadcast(blobs) if small else blobs, ["doc_id", "twin"], how)

    @staticmethod
    def _texts(docs: DataFrame) -> DataFrame:
        """(doc_id, twin, text): ``twin`` tells rows apart that repeat an id, by their texts; 0 elsewhere."""
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        repeated = materialize(texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")))
        if repeated.limit(1).count() == 0:
            return texts.select("doc_id", F.lit(0).cast("long").alias("twin"), "text")
        twin = F.when(F.col("again"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0)).cast("long")
        return texts.join(sized(repeated), "doc_id", "left").select("doc_id", twin.alias("twin"), "text")

    def spans(self, texts: DataFrame) -> DataFrame:
        """(doc_id, twin, blob): the byte ranges to remove, int64 pairs, for every document that loses bytes."""
        spark = texts.sparkSession
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        buckets = min(1 << 30, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // self.bucket_bytes)))
        dealt = texts.mapInArrow(self._samples(buckets), _ROW).repartition("bucket").sortWithinPartitions("bucket", "kind")
        ties = materialize(dealt.mapInArrow(self._ties, _SPANS))

        def asked(kind: int) -> DataFrame:
            rows = ties.where(F.col("kind") == kind).groupBy(F.col("doc").alias("doc_id"), "twin")
            return materialize(rows.agg(F.array_join(F.collect_list(F.hex("blob")), "").alias("h")).select("doc_id", "twin", F.unhex("h").alias("blob")))

        contexts = self._joined(texts, asked(_ASKED), "inner").mapInArrow(
            self._contexts, "seed long, doc long, twin long, pos long, llen int, rlen int, text binary"
        )
        rows = ties.where(F.col("kind").isin(_SPAN, _STARTS))
        rows = rows.union(materialize(contexts.repartition("seed").sortWithinPartitions("seed").mapInArrow(self._blocks, _SPANS)))
        if ties.where(F.col("kind") == _WINDOWS).limit(1).count():
            rows = rows.union(materialize(self._split(texts, asked(_WINDOWS))))
        rows = rows.repartition("doc", "twin").sortWithinPartitions("doc", "twin")
        return materialize(rows.mapInArrow(self._union, "doc_id long, twin long, blob binary"))

    def _digest(self, batches):
        for batch in batches:
            data, offs = textkit.as_bytes(textkit.text_column(batch, "text"))
            out = [[], [], [], []]
            for i, blob in enumerate(batch.column("blob").to_pylist()):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                s = np.frombuffer(blob or b"", np.int64).reshape(-1, 2)
                edges = np.concatenate([[0], np.minimum(s, len(raw)).ravel(), [len(raw)]]).tolist()
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for o, x in zip(out, (len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest())):
                    o.append(x)
            arrays = [batch.column("doc_id"), *(pa.array(o, t) for o, t in zip(out, (*[pa.int64()] * 3, pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def digest(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row."""
        texts = self._texts(docs)
        rows = self._joined(texts, self.spans(texts), "left").select("doc_id", "text", "blob")
        return rows.mapInArrow(self._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    @staticmethod
    def _cuts(at: int):
        """Batches without their last column, the spans, which are cut out of column ``at``; they leave in parts."""

        def batches(batches):
            for batch in batches:
                for part in _parts(batch, batch.column(at), _CUT_BYTES):
                    column, blobs = part.column(at).cast(pa.string()), part.column(part.num_columns - 1)
                    if blobs.null_count < len(blobs):
                        texts = column.to_pylist()
                        for i, blob in enumerate(blobs.to_pylist()):
                            if blob and texts[i]:
                                raw = texts[i].encode()
                                s = np.frombuffer(blob, np.int64).reshape(-1, 2)
                                edges = [0, *np.minimum(s, len(raw)).ravel().tolist(), len(raw)]
                                texts[i] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")
                        column = pa.array(texts, pa.string())
                        del texts
                    arrays = [column if j == at else part.column(j) for j in range(part.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names[:-1])
                    del part, column, blobs, arrays
            batch = None
            textkit.trim()

        return batches

    def rewrite(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the ranges cut out of ``text``; a cut character's other bytes go too; all columns stay, whatever
        their names."""
        spans = self.spans(self._texts(docs))
        size = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("b")).first()
        own = spans.select(*(F.col(c).alias(free_name(docs, c)) for c in ("doc_id", "twin", "blob")))
        doc, twin, blob = own.columns
        if size["n"] <= BROADCAST_ROWS and size["b"] <= self.bytes_limit:
            own = F.broadcast(own)
        same = (docs["doc_id"].cast("long") == F.col(doc)) & ((F.col(twin) == 0) | (F.col(twin) == F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))))
        rows = docs.join(own, same, "left").select(*[docs[c] for c in docs.columns], F.col(blob))
        at = docs.columns.index("text")
        return rows.mapInArrow(self._cuts(at), T.StructType([T.StructField("text", T.StringType()) if j == at else f for j, f in enumerate(docs.schema.fields)]))


def _parts(batch: pa.RecordBatch, column: pa.Array, limit: int):
    """Slices of about ``limit`` bytes of a text column, in whole rows."""
    for lo, hi, _, _ in textkit.chunks(textkit.filled(column), limit):
        yield batch.slice(lo, hi - lo)


def _slices(batches, limit: int):
    """Record batches of about ``limit`` bytes of text, in whole rows."""
    for batch in batches:
        yield from _parts(batch, batch.column(batch.schema.get_field_index("text")), limit)


def _pack(seed: np.ndarray, ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray, twin: np.ndarray) -> bytes:
    """Planes: count, seeds, contexts, document steps (ascending), positions in halves, twins if there are any."""
    step = np.diff(doc, prepend=doc[:1])
    wide = len(step) > 0 and int(step.max()) >= 1 << 16
    head = np.array([len(seed), int(wide) + 2 * int(twin.any()), int(doc[0]) if len(doc) else 0], np.int64)
    planes = (head, seed, ctx, step.astype(np.int64 if wide else np.uint16), (pos & 0xFFFF).astype(np.uint16), (pos >> 16).astype(np.uint32), twin if twin.any() else twin[:0])
    return b"".join(p.tobytes() for p in planes)


def _unpack(buf) -> tuple[np.ndarray, ...]:
    n, flags, base = np.frombuffer(buf, np.int64, 3).tolist()
    at, out = 24, []
    for kind in (U64, U64, np.int64 if flags & 1 else np.uint16, np.uint16, np.uint32, *[np.int64] * (flags >> 1)):
        out.append(np.frombuffer(buf, kind, n, at))
        at += n * np.dtype(kind).itemsize
    seed, ctx, step, low, high = out[:5]
    twin = out[5] if flags >> 1 else np.zeros(n, np.int64)
    return seed, ctx, base + np.cumsum(step.astype(np.int64)), low.astype(np.int64) | (high.astype(np.int64) << 16), twin
