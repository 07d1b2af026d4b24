"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search.

Build: every vector starts with ``starts`` x ``group`` random neighbours.  A step joins, around every vector, its
neighbours and reverse neighbours: pairs with a neighbour that is new since it was last joined are compared, pairs of two old
ones are not, and each vector keeps its ``k`` best.  Steps go on until fewer than ``settled`` of all neighbours change,
``descents`` at most.  Equal vectors are one node, kept with its ``top + 1`` smallest ids, so a group of
copies costs one node and loses no answer.

As in the method's paper, a step samples: of the new and of the old edges a share ``rate``; the neighbours of a node that is
near to very many are joined in random parts of about ``part``, other parts at each step; and of what a join finds for a
vector the ``found`` best are told.

Search: a query starts at its own node and expands, ``steps`` times, the best ``width`` nodes of its beam
that it has not expanded, by joining them with the neighbour lists.  The final beam is scored again in double
precision on the original vectors.  Before that vectors are divided by the table's largest component, so that neither
single nor half precision overflows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm import textkit
from meridia.llm.support import materialize, sized

U64 = np.uint64
LIST = "u long, ids binary, scores binary, fresh binary"
_FILE = 4 << 20
_OLD, _NEW, _FOUND = 0, 1, 2  # of a neighbour: joined before, not yet joined, found in this step


def _blobs(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """One binary cell for each run of ``values``."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def _best(u, ids, scores, fresh, k: int) -> pa.RecordBatch:
    """Per u its distinct ids, best first, ``k`` at most; a neighbour known before stays what it was."""
    order = np.lexsort((fresh, ids, u))
    u, ids, scores, fresh = u[order], ids[order], scores[order], fresh[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (ids[1:] != ids[:-1])
    u, ids, scores, fresh = u[first], ids[first], scores[first], fresh[first]
    order = np.lexsort((ids, -scores, u))
    u, ids, scores, fresh = u[order], ids[order], scores[order], fresh[order]
    start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(start, len(u)))
    kept = np.arange(len(u)) - np.repeat(start, sizes) < k
    offs = np.concatenate([[0], np.cumsum(np.minimum(sizes, k))])
    cells = [_blobs(x[kept], offs) for x in (ids.astype(np.int64), scores.astype(np.float32), fresh.astype(np.uint8))]
    return pa.RecordBatch.from_arrays([pa.array(u[start].astype(np.int64)), *cells], names=["u", "ids", "scores", "fresh"])


def _flat(column, kind) -> np.ndarray:
    """All cells of a binary column, one after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros(0, kind)
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if offs[0] == offs[-1]:
        return np.zeros(0, kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(kind)


def _entries(batch) -> tuple[np.ndarray, ...]:
    """u, ids, scores, fresh of all neighbours in a batch of lists."""
    u, ids = batch.column("u").to_numpy(), _flat(batch.column("ids"), np.int64)
    sizes = np.array([len(x) // 8 for x in batch.column("ids").to_pylist()], np.int64)
    return np.repeat(u, sizes), ids, _flat(batch.column("scores"), np.float32), _flat(batch.column("fresh"), np.uint8)


def _merge(k: int):
    """Union of the lists of each u, from batches sorted by it."""

    def batches(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _entries(batch)
            if held is not None:
                now = tuple(map(np.concatenate, zip(held, now)))
            last = batch.column("u")[-1].as_py()
            done = now[0] != last
            held = tuple(x[~done] for x in now)
            if done.any():
                yield _best(*(x[done] for x in now), k)
            if len(held[0]) > 50 * k:  # very many lists of one u
                held = _entries(_best(*held, k))
        if held is not None and len(held[0]):
            yield _best(*held, k)

    return batches


def _floats(column, kind=np.float32) -> np.ndarray:
    """A binary column of equally long vectors as a matrix."""
    flat = _flat(column, kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


class NNDescent:
    def __init__(self, top=20, k=40, starts=8, group=6, rate=0.5, part=64, found=10, descents=12, settled=0.015, steps=8, width=24, beam=192, broadcast_bytes=32 << 20, seed=7):
        self.top, self.k, self.starts, self.group, self.rate, self.part, self.found = top, k, starts, group, rate, part, found
        self.descents, self.settled, self.steps, self.width, self.beam, self.seed = descents, settled, steps, width, beam, seed
        self.broadcast_bytes = broadcast_bytes
        self.files = 0  # most files of a table written on the way; 0: one for each partition
        self.shares: list[float] = []  # changed neighbours of each step of the last build

    # nodes
    @staticmethod
    def valid(vectors: DataFrame) -> DataFrame:
        """(vec_id, v): vectors that take part.  Of two lengths the shorter counts as ending in zeros."""
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.where("vec_id is not null and v is not null and size(v) > 0").where(~odd & F.exists("v", lambda x: x != 0))

    @staticmethod
    def _packed(width: int, scale: float):
        def batches(batches):
            for batch in batches:
                v = batch.column("v")
                flat, sizes = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
                rows = np.zeros((len(v), width), np.float32)
                rows[np.arange(width)[None, :] < sizes[:, None]] = flat / scale
                yield pa.RecordBatch.from_arrays([batch.column("node"), _blobs(rows.ravel(), width * np.arange(len(v) + 1))], names=["node", "vec"])

        return batches

    # the first graph
    def _first(self, batches):
        out = []
        for group in textkit.sorted_groups(batches, ["r", "bucket"]):
            ids, x = group.column("node").to_numpy(), _floats(group.column("vec"))
            s = x @ x.T
            i, j = np.nonzero(ids[:, None] != ids[None, :])
            out.append((ids[i], ids[j], s[i, j]))
            if len(out) >= 2000:
                yield self._found(out)
                out = []
        if out:
            yield self._found(out)

    def _found(self, parts) -> pa.RecordBatch:
        u, ids, scores = map(np.concatenate, zip(*parts))
        return _best(u, ids, scores, np.full(len(u), _FOUND, np.uint8), self.k)

    def _gathered(self, df: DataFrame) -> DataFrame:
        """Neighbouring partitions in one task: a small table on many partitions isn't as many files, each with its own folder."""
        return df.coalesce(self.files) if self.files else df

    def _size(self, df: DataFrame, n: int) -> None:
        """Files of 4 MB of lists, and two for each core at least."""
        self.files = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n * self.k * 13 // _FILE))

    def _merged(self, lists: DataFrame, k: int) -> DataFrame:
        rows = self._gathered(lists.repartition("u").sortWithinPartitions("u"))  # a list's rows stay together, and in order
        return materialize(rows.mapInArrow(_merge(k), LIST))

    # descent
    def _picked(self, u: np.ndarray, v: np.ndarray, step: int) -> np.ndarray:
        key = textkit.mix(u.astype(U64) * U64(31) + textkit.mix(v.astype(U64)), step + self.seed)
        return (key >> U64(40)).astype(np.float64) < self.rate * (1 << 24)

    def _edges(self, step: int):
        """(center, node, new) of both directions, for the edges picked at this step."""

        def batches(batches):
            for batch in batches:
                u, v, _, fresh = _entries(batch)
                pick = self._picked(u, v, step)
                u, v, new = u[pick], v[pick], (fresh[pick] != _OLD).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[u, v]), pa.array(np.r_[v, u]), pa.array(np.r_[new, new])], names=["center", "node", "new"])

        return batches

    def _aged(self, step: int):
        """The graph after the step's edges were joined."""

        def batches(batches):
            for batch in batches:
                u, v, scores, fresh = _entries(batch)
                yield _best(u, v, scores, np.where((fresh == _OLD) | self._picked(u, v, step), _OLD, _NEW), self.k)

        return batches

    def _local(self, batches):
        out, size = [], 0
        for group in textkit.sorted_groups(batches, ["center", "salt"]):
            new = group.column("new").to_numpy() > 0
            if len(group) < 2 or not new.any():
                continue
            ids, worst, x = group.column("node").to_numpy(), group.column("worst").to_numpy(), _floats(group.column("vec"))
            s = x @ x.T
            s[~(new[:, None] | new[None, :]) | (s <= worst[:, None])] = -np.inf
            np.fill_diagonal(s, -np.inf)
            m = min(self.found, len(ids) - 1)
            near = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(ids) else np.tile(np.arange(len(ids)), (len(ids), 1))
            score = np.take_along_axis(s, near, 1)
            i, j = np.nonzero(np.isfinite(score))
            if len(i):
                out.append((ids[i], ids[near[i, j]], score[i, j]))
                size += len(i)
            if size > 200_000:  # what a task finds for one vector leaves together
                yield self._found(out)
                out, size = [], 0
        if out:
            yield self._found(out)

    def _worst(self, batches):
        for batch in batches:
            scores = [np.frombuffer(s, np.float32) for s in batch.column("scores").to_pylist()]
            worst = [float(s[-1]) if len(s) >= self.k else -np.inf for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array(worst, pa.float32())], names=["node", "worst"])

    def start(self, nodes: DataFrame, n: int) -> DataFrame:
        """(u, ids, scores, fresh): random neighbours, from ``starts`` dealings of all nodes into groups."""
        buckets = max(1, n // self.group)
        rows = nodes.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(self.starts if buckets > 1 else 1))))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("node", "r", F.lit(self.seed)), F.lit(buckets)))
        dealt = rows.repartition("r", "bucket").sortWithinPartitions("r", "bucket")
        return self._merged(dealt.mapInArrow(self._first, LIST), self.k)

    def graph(self, nodes: DataFrame) -> DataFrame:
        """(u, ids, scores, fresh): the k best neighbours found for each node of (node, vec)."""
        n = nodes.count()
        self._size(nodes, n)
        graph, self.shares = self.start(nodes, n), []
        for step in range(self.descents):
            known = nodes.join(graph.mapInArrow(self._worst, "node long, worst float"), "node")
            edges = graph.mapInArrow(self._edges(step), "center long, node long, new int").groupBy("center", "node").agg(F.max("new").alias("new"))
            edges = materialize(self._gathered(edges))
            crowds = edges.groupBy("center").count().where(F.col("count") > 1.5 * self.part).select("center", F.ceil(F.col("count") / self.part).alias("parts"))
            crowds = sized(materialize(self._gathered(crowds)))
            salt = F.pmod(F.xxhash64("node", F.lit(step)), F.coalesce("parts", F.lit(1))).cast("int")
            edges = edges.join(crowds, "center", "left").select("center", "node", "new", salt.alias("salt"))
            rows = edges.join(known, "node").select("center", "salt", "node", "new", "worst", "vec")
            found = rows.repartition("center", "salt").sortWithinPartitions("center", "salt").mapInArrow(self._local, LIST)
            graph = self._merged(graph.mapInArrow(self._aged(step), LIST).union(found), self.k)
            total = graph.mapInArrow(_changed, "n long, changed long").agg(F.sum("n"), F.sum("changed")).first()
            self.shares.append((total[1] or 0) / max(1, total[0] or 0))
            if self.shares[-1] < self.settled:
                break
        return graph

    @staticmethod
    def _reverse(batches):
        for batch in batches:
            u, v, scores, fresh = _entries(batch)
            yield _best(v, u, scores, fresh, len(u) + 1)

    # search
    def _adjacent(self, batches):
        """Neighbour lists with the neighbours' vectors in half precision, a few neighbours a row so that batches stay small."""
        out: list[list] = [[], [], []]
        for group in textkit.sorted_groups(batches, ["u"]):
            for lo in range(0, len(group), 12):
                part = group.slice(lo, 12)
                out[0].append(part.column("u")[0].as_py())
                out[1].append(part.column("node").to_numpy().tobytes())
                out[2].append(_floats(part.column("vec")).astype(np.float16).tobytes())
            if len(out[0]) >= 200:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *map(textkit.binary_array, out[1:])], names=["u", "ids", "vecs"])
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *map(textkit.binary_array, out[1:])], names=["u", "ids", "vecs"])

    def _expand(self, batches):
        for batch in batches:
            q, ids, scores = [], [], []
            for a, vec, near, vecs in zip(batch.column("q").to_pylist(), *(batch.column(c) for c in ("qvec", "ids", "vecs"))):
                x = np.frombuffer(vec.as_buffer(), np.float32)
                ids.append(np.frombuffer(near.as_buffer(), np.int64))
                scores.append(np.frombuffer(vecs.as_buffer(), np.float16).astype(np.float32).reshape(-1, len(x)) @ x)
                q.append(np.full(len(ids[-1]), a))
            if q:
                q, ids, scores = map(np.concatenate, (q, ids, scores))
                yield _best(q, ids, scores, np.zeros(len(q), np.uint8), self.beam)

    def _frontier(self, batches):
        """The best unexpanded nodes of each beam; what has been expanded is a list of its own."""
        for batch in batches:
            q, node = [], []
            for u, ids, done in zip(*(batch.column(c).to_pylist() for c in ("u", "ids", "done"))):
                ids = np.frombuffer(ids, np.int64)
                new = ids[~np.isin(ids, np.frombuffer(done or b"", np.int64))][: self.width]
                q += [u] * len(new)
                node += new.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(node, pa.int64())], names=["q", "node"])

    def search(self, nodes: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
        """(u, ids, scores, fresh): the beam of each query of (node), which is a node itself."""
        both = self._merged(graph.union(graph.mapInArrow(self._reverse, LIST)), self.k + self.k // 4)
        pairs = both.mapInArrow(_pairs, "u long, node long")
        rows = pairs.join(nodes, "node").select("u", "node", "vec").repartition("u").sortWithinPartitions("u")
        lists = materialize(rows.mapInArrow(self._adjacent, "u long, ids binary, vecs binary"))  # far larger than the graph
        start = queries.select(F.col("node").alias("q")).distinct()
        known = materialize(start.join(nodes.withColumnRenamed("node", "q"), "q").withColumnRenamed("vec", "qvec"))
        own = both.join(start.withColumnRenamed("q", "u"), "u", "left_semi")
        one = nodes.select(F.length("vec").alias("b")).first()
        most = self.broadcast_bytes // ((one["b"] if one else 0) + 32)  # asked nodes, each with its query's vector
        beam, done = materialize(own), None
        for _ in range(self.steps):
            state = beam.join(done, "u", "left") if done is not None else beam.withColumn("done", F.lit(None).cast("binary"))
            front = materialize(self._gathered(state).mapInArrow(self._frontier, "q long, node long"))
            asked = front.count()
            if asked == 0:
                break
            ask = front.join(known, "q").withColumnRenamed("node", "u")
            ask = F.broadcast(ask) if asked <= most else ask
            found = lists.join(ask, "u").mapInArrow(self._expand, LIST)
            beam = self._merged(beam.union(found), self.beam)
            packed = front.groupBy(F.col("q").alias("u")).agg(F.collect_list("node").alias("n"))  # `width` at most
            new = packed.mapInArrow(_pack_nodes, "u long, done binary")
            if done is not None:
                old = done.withColumnRenamed("done", "was")
                new = new.join(old, "u", "full").select("u", F.concat(F.coalesce("done", F.unhex(F.lit(""))), F.coalesce("was", F.unhex(F.lit("")))).alias("done"))
            done = materialize(self._gathered(new))
        return beam

    def __call__(self, vectors: DataFrame, is_query=None) -> DataFrame:
        """query_id, rank, vec_id, score; nulls, zeros and non-finite vectors take no part; an empty table gives no rows.

        Rows repeating a vec_id with one vector count once; rows repeating it with different vectors are candidates of
        their own, and queries that are answered together.
        """
        rows = materialize(self.valid(vectors).distinct())
        most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
        size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d"), F.coalesce(most, F.lit(1.0)).alias("m")).first()
        groups = materialize(rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
        nodes = materialize(groups.select("node", "v").mapInArrow(self._packed(size["d"], size["m"]), "node long, vec binary"))
        copies = rows.join(materialize(groups.where("n > 1").select("v", "node")), "v").select("node", "vec_id")
        salted = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
        few = materialize(copies.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= self.top + 1).drop("r"))
        whole = Window.partitionBy("node").orderBy("vec_id")
        few = few.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= self.top + 1).drop("r")
        members = materialize(groups.where("n = 1").select("node", F.col("node").alias("vec_id")).union(few))
        is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
        asked = materialize(rows.where(is_query).join(groups.select("v", "node"), "v").select("vec_id", "node"))
        beam = self.search(nodes, self.graph(nodes), asked)
        own = asked.select(F.col("node").alias("u"), F.col("node")).distinct()
        cand = beam.mapInArrow(_pairs, "u long, node long").union(own).distinct()
        vec = groups.select("node", "v")
        pairs = cand.join(vec, "node").join(vec.select(F.col("node").alias("u"), F.col("v").alias("w")), "u")
        dot = F.aggregate(F.zip_with("v", "w", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        scored = materialize(pairs.select("u", "node", dot.alias("score")))
        out = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("u")).join(scored, "u").join(members, "node")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        out = out.where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= self.top)
        return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _changed(batches):
    for batch in batches:
        fresh = _flat(batch.column("fresh"), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([len(fresh)], pa.int64()), pa.array([int((fresh == _FOUND).sum())], pa.int64())], names=["n", "changed"])


def _pairs(batches):
    for batch in batches:
        u, ids, _, _ = _entries(batch)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(ids)], names=["u", "node"])


def _pack_nodes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("u"), textkit.binary_array([np.array(n, np.int64).tobytes() for n in batch.column("n").to_pylist()])], names=["u", "done"])
