"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signature: one permutation (a bijective mixer, cut to ``2**LOG`` slots) scatters a shingle to slot x; one
table holds a second permutation, and coordinate k reads it circularly shifted by k, at ``x + k``.  So
all coordinates of a shingle are one contiguous slice of the table, and a signature is the slices'
minimum.  Bands of ``rows`` coordinates are hashed to buckets.

Links: documents with equal shingle sets are one class, which its smallest id represents.  In each bucket
every class is compared with two hubs, its smallest id and its most connected member; true links (exact
Jaccard on full sets) unite classes, and only where a bucket then still holds several components are
its remaining pairs across components compared, so a group of near copies costs a star, not a clique.  Those pairs
first meet an upper bound of their intersection, which never discards a link: shingles counted by slots of their hash,
the lesser count of each slot summed.
Hub sets are shipped once per ``fan`` members (salting), members once per hub.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import textkit
from meridia.llm.support import BROADCAST_ROWS, components, materialize, sized

U64 = np.uint64
LOG = 21
SHINGLE = 5


@lru_cache(maxsize=1)
def _table(width: int) -> np.ndarray:
    size = 1 << LOG
    order = np.argsort(textkit.mix(np.arange(size, dtype=U64), 77), kind="stable").astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: width - 1]]), width)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending inside a row, and each row's first index.

    A row with fewer words than ``width`` has its whole sequence as one shingle; without words, none.
    """
    low = textkit.LOWER[buf]
    starts, ends, first = textkit.words(low, offs)
    h = textkit.span_hash(textkit.prefix_sums(low), starts, ends)
    n = np.diff(first)
    row = textkit.row_of(first)
    rolled = textkit.rolling(h, width)
    full = np.flatnonzero(row[: len(rolled)] == row[width - 1 :]) if len(rolled) else np.zeros(0, np.int64)
    keys, rows = [rolled[full]], [row[full]]
    for k in range(1, width):
        at = first[:-1][n == k]
        if len(at):
            run = np.zeros(len(at), U64)
            for j in range(k):
                run = run * U64(0xFF51AFD7ED558CCD) + h[at + j]
            keys.append(textkit.mix(run, k))
            rows.append(np.flatnonzero(n == k))
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.searchsorted(row[new], np.arange(len(offs)))


def signatures(keys: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Signatures of the rows that have shingles, in row order."""
    view, slot = _table(width), (textkit.mix(keys, 5) >> U64(64 - LOG)).astype(np.int64)
    filled = np.flatnonzero(np.diff(first))
    out = np.empty((len(filled), width), np.uint32)
    step = max(64, (1 << 20) // width)
    # Long rows are folded in pieces, so memory stays bounded.
    for i, r in enumerate(filled.tolist()):
        lo, hi = int(first[r]), int(first[r + 1])
        best = view[slot[lo : min(hi, lo + step)]].min(axis=0)
        for at in range(lo + step, hi, step):
            np.minimum(best, view[slot[at : at + step]].min(axis=0), out=best)
        out[i] = best
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.shape[1] // rows
    acc = np.zeros((len(sig), bands), U64)
    for j in range(rows):
        acc = textkit.mix(acc * U64(0xFF51AFD7ED558CCD) + sig[:, j::rows][:, :bands].astype(U64))
    return textkit.mix(acc + np.arange(bands, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15))


#: Most slots of a mark, and the count that a byte can't pass.
SLOTS, FULL = 1 << 14, 255


def mark(keys: np.ndarray) -> bytes:
    """Shingles counted by slots of their hash, two slots a shingle or more up to ``SLOTS``; empty where a count overflows."""
    log = int(min(SLOTS, max(64, 2 * len(keys))) - 1).bit_length()
    counts = np.bincount((textkit.mix(keys, 21) >> U64(64 - log)).astype(np.int64), minlength=1 << log)
    return counts.astype(np.uint8).tobytes() if counts.max() <= FULL else b""


def folded(marks: np.ndarray, slots: int) -> np.ndarray:
    """Marks with fewer slots: neighbouring slots are added up."""
    return marks.reshape(len(marks), slots, -1).sum(axis=2, dtype=np.uint16)


def most_shared(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of one mark with others of one length."""
    slots = min(len(one), others.shape[1])
    return np.minimum(folded(one[None, :], slots), folded(others, slots)).sum(axis=1, dtype=np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct keys."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum()) if len(large) else 0


class NearDuplicates:
    """``percent``: least Jaccard similarity, in hundredths.  ``bands`` x ``rows`` coordinates: a pair at 0.75
    misses every band with probability (1 - 0.75**4)**32 < 6e-6; no pair that shares a band is lost.
    ``fan``: parts into which a hub's members are dealt.  ``block``: rows of a bucket compared in one group; larger
    buckets are cut into blocks.
    """

    def __init__(self, percent=75, bands=32, rows=4, fan=64, block=256):
        self.percent, self.bands, self.rows, self.fan, self.block = percent, bands, rows, fan, block

    def _describe(self, batches):
        width, rows = self.bands * self.rows, self.rows
        for batch in batches:
            n, s1, s2, found, lens = [], [], [], [], []
            for _, _, buf, offs in textkit.chunks(textkit.text_column(batch, "text")):
                keys, first = shingle_sets(buf, offs)
                for salt, out in ((11, s1), (13, s2)):
                    acc = np.zeros(len(keys) + 1, U64)
                    np.cumsum(textkit.mix(keys, salt), out=acc[1:])
                    out.append((acc[first[1:]] - acc[first[:-1]]).view(np.int64))
                n.append(np.diff(first))
                found.append(band_hashes(signatures(keys, first, width), rows).view(np.int64).ravel())
                lens.append((np.diff(first) > 0) * self.bands)
            cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(cat(lens))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cat(found)))
            arrays = [batch.column("doc_id"), pa.array(cat(n)), pa.array(cat(s1)), pa.array(cat(s2)), bands]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    def _sets(self, batches):
        for batch in batches:
            blobs, marks, bands, n = [], [], [], []
            for _, _, buf, offs in textkit.chunks(textkit.text_column(batch, "text")):
                keys, first = shingle_sets(buf, offs)
                own = band_hashes(signatures(keys, first, self.bands * self.rows), self.rows)
                full = iter(range(len(own)))
                for i in range(len(offs) - 1):
                    blobs.append(keys[first[i] : first[i + 1]].tobytes())
                    at = next(full) if first[i + 1] > first[i] else -1
                    marks.append(mark(keys[first[i] : first[i + 1]]) if at >= 0 else b"")
                    bands.append(own[at].tobytes() if at >= 0 else b"")
                n += np.diff(first).tolist()
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), *map(textkit.binary_array, (blobs, marks, bands))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n", "keys", "marks", "bands"])

    def _confirm(self, batches):
        for group in textkit.sorted_groups(batches, ["c", "salt"]):
            keys = [np.frombuffer(x.as_buffer(), U64) for x in group.column("keys")]
            ids, side = group.column("m").to_pylist(), group.column("side").to_pylist()
            hubs = [k for k, s in zip(keys, side) if s == 0]
            a, b = [], []
            for i, k, s in zip(ids, keys, side):
                for hub in hubs if s else ():
                    both = similar(hub, k)
                    if 100 * both >= self.percent * (len(hub) + len(k) - both):
                        a.append(group.column("c")[0].as_py())
                        b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of (c, m) whose full sets are similar enough, as (a, b)."""
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("m"), F.lit(self.fan)).cast("int"))
        keys = sets.select("doc", "keys")
        members = salted.join(keys.withColumnRenamed("doc", "m"), "m").select("c", "salt", F.lit(1).alias("side"), "m", "keys")
        hubs = salted.select("c", "salt").distinct().join(keys.withColumnRenamed("doc", "c"), "c")
        rows = hubs.select("c", "salt", F.lit(0).alias("side"), F.col("c").alias("m"), "keys").union(members)
        dealt = rows.repartition("c", "salt").sortWithinPartitions("c", "salt", "side")
        return dealt.mapInArrow(self._confirm, "a long, b long")

    def _block_pairs(self, batches):
        for group in textkit.sorted_groups(batches, ["bucket", "i", "j"]):
            group = group.filter(pa.compute.greater(group.column("n"), 0))
            if not len(group):
                continue
            raw = [np.frombuffer(m, np.uint8) for m in group.column("marks").to_pylist()]
            size = np.array([len(m) for m in raw])
            held = {int(k): (np.flatnonzero(size == k), np.stack([raw[r] for r in np.flatnonzero(size == k).tolist()])) for k in np.unique(size) if k}
            place = np.zeros(len(raw), np.int64)
            for rows, _ in held.values():
                place[rows] = np.arange(len(rows))
            bands = np.frombuffer(b"".join(group.column("bands").to_pylist()), np.int64).reshape(len(group), -1)
            doc, comp, n, blk = (group.column(c).to_numpy() for c in ("doc", "comp", "n", "blk"))
            bucket, i, j = (group.column(c)[0].as_py() for c in ("bucket", "i", "j"))
            left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
            a, b = [], []
            for x in left.tolist():
                y = right if i != j else right[right > x]
                y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= self.percent * np.maximum(n[y], n[x]))]
                if not len(y):
                    continue
                y = y[bands[x, (bands[y] == bands[x]).argmax(axis=1)] == bucket]  # told once, by the first bucket that both share
                shared = np.minimum(n[y], n[x])
                for k, (_, marks) in held.items() if size[x] else ():
                    at = np.flatnonzero(size[y] == k)
                    if len(at):
                        shared[at] = np.minimum(shared[at], most_shared(raw[x], marks[place[y[at]]]))
                y = y[100 * shared >= self.percent * (n[y] + n[x] - shared)]
                a += np.minimum(doc[y], doc[x]).tolist()
                b += np.maximum(doc[y], doc[x]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["c", "m"])

    def remaining(self, shared: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (c, m) of buckets that still hold several components, which their marks can't tell apart."""
        comps = components(links).withColumnRenamed("id", "doc")
        held = materialize(shared.join(comps, "doc", "left").select("bucket", "doc", F.coalesce("comp", "doc").alias("comp")))
        mixed = held.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("rows"))
        mixed = mixed.where("c0 < c1").select("bucket", F.ceil(F.col("rows") / self.block).cast("int").alias("nb"))
        rows = held.join(materialize(mixed), "bucket").withColumn("blk", F.pmod(F.hash("doc"), F.col("nb")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        rows = rows.select("bucket", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "doc", "comp")
        rows = rows.join(sets.select("doc", "n", "marks", "bands"), "doc").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        return rows.mapInArrow(self._block_pairs, "c long, m long").distinct()

    def __call__(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id, kept: one row per input row.

        Null, empty and wordless texts have no shingles and are their own component; a null id has a null
        component and is kept; rows repeating an id share its component.
        """
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        known = materialize(narrow.mapInArrow(self._describe, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"))
        some = known.where("n_shingles > 0 and doc_id is not null")
        reps = materialize(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands")))
        rows = reps.select("doc", F.explode("bands").alias("bucket"))
        full = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc").alias("lo")).where("n > 1"))
        shared = materialize(rows.join(full, "bucket").select("bucket", "doc", "n", "lo"))
        weight = shared.groupBy("doc").agg(F.sum("n").alias("w"))
        hubs = shared.join(weight, "doc").groupBy("bucket").agg(F.max(F.struct("w", -F.col("doc"))).alias("h"))
        hubs = materialize(hubs.select("bucket", (-F.col("h.col2")).alias("hub")))
        pairs = shared.join(hubs, "bucket").select(F.col("doc").alias("m"), F.explode(F.array("lo", "hub")).alias("c"))
        pairs = pairs.where("m <> c").select(F.greatest("m", "c").alias("m"), F.least("m", "c").alias("c"))
        pairs = materialize(pairs.distinct())
        candidates = sized(shared.select(F.col("doc").alias("doc_id")).distinct(), BROADCAST_ROWS)
        sets = materialize(narrow.join(candidates, "doc_id").mapInArrow(self._sets, "doc long, n long, keys binary, marks binary, bands binary"))
        links = materialize(self.confirmed(pairs, sets))
        rest = materialize(self.remaining(shared.select("bucket", "doc"), links, sets).join(pairs, ["c", "m"], "left_anti"))
        links = links.union(materialize(self.confirmed(rest, sets)))
        comps = components(links).withColumnRenamed("id", "doc")
        classes = materialize(reps.join(comps, "doc", "left").select("s1", "s2", F.coalesce("comp", "doc").alias("class_id")))
        out = known.drop("bands").join(classes, ["s1", "s2"], "left")
        comp = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
