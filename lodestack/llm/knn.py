"""Most similar vectors for every vector: learned partitions.

A bounded sample is fitted: its neighbour graph is partitioned into balanced parts, and a small linear classifier
learns to tell a vector's part. Every vector is routed to its several most probable parts, where it is both indexed
and a query; there the candidates are reranked by exact cosine. Two vectors are compared if their parts overlap, so
a vector near a border is found from either side. Exact copies of a vector are collapsed to one before the search
and joined again behind it.

Parts hold ``PART_ROWS`` vectors whatever the collection's size: where one classifier would have more than
``MAX_BRANCH`` parts, classifiers form a tree, in which each node is fitted on a bounded sample of its own vectors, in
one task per node. The upper levels are broadcast (at most ``MAX_BRANCH ** 2`` parts); the last one is broadcast within
``ROUTER_BYTES`` and otherwise sent to the rows of its nodes by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the vector collection.
DIM, TOP = 384, 5
#: Bound of the vectors the partitions and the classifier are fitted on.
MAX_SAMPLE = 12_000
#: Vectors a part should hold; parts are added as the collection grows.
PART_ROWS = 5_000
#: Parts of one classifier.
MAX_BRANCH = 128
#: Bytes of the last level's classifiers up to which they are broadcast.
ROUTER_BYTES = 64 * 1024 * 1024
#: Nodes that a vector follows down the tree: where every task has the last level, and where its nodes are met by a shuffle.
NODE_BEAM, FAR_BEAM = 4, 3
#: Parts a vector goes to under one classifier: at least and at most, and the probability they should cover. In a tree it
#: goes to the most for every level, as either level parts neighbours.
MIN_PROBES, MAX_PROBES, COVER = 2, 3, 0.6
#: Index rows that one task searches at a time; larger parts are searched in blocks of this size, and their queries in
#: blocks of four times as many.
BLOCK_ROWS = 40_000
#: Rows of a node that one task routes where the last level is not broadcast.
ROUTED_ROWS = 50_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def neighbour_graph(x: np.ndarray, k: int, step: int = 1024) -> np.ndarray:
    """Indices of the ``k`` nearest other rows of every unit row."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int32)
    for a in range(0, len(x), step):
        s = x[a : a + step] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + step] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, rng: np.random.Generator, rounds: int = 8, slack: float = 1.15) -> np.ndarray:
    """Balanced partition of a neighbour graph: bisection for a start, then label propagation under capacities."""
    label = np.zeros(len(x), dtype=np.int64)
    todo, done = [(np.arange(len(x)), n_parts)], 0
    while todo:
        rows, parts = todo.pop()
        if parts == 1 or len(rows) < 2:
            label[rows] = done
            done += 1
            continue
        y = x[rows]
        c = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(6):  # two means give the direction, the quantile keeps the halves in proportion
            side = y @ (c[1] - c[0])
            cut = np.quantile(side, 1 - (parts // 2) / parts)
            one = side > cut
            if one.all() or not one.any():
                one = np.arange(len(y)) % 2 == 1
            c = np.stack([y[~one].mean(axis=0), y[one].mean(axis=0)])
        todo += [(rows[~one], parts - parts // 2), (rows[one], parts // 2)]
    n_parts = done
    room = int(np.ceil(slack * len(x) / n_parts)) + 1
    size = np.bincount(label, minlength=n_parts)
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            near = label[np.concatenate([graph[i], np.array(back[i][:50], dtype=np.int64)]).astype(np.int64)]
            votes = np.bincount(near, minlength=1)
            best = int(votes.argmax())
            if best != label[i] and size[best] < room and votes[best] > (votes[label[i]] if label[i] < len(votes) else 0):
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


class Router:
    """Linear softmax classifier of unit vectors into parts."""

    def __init__(self, x: np.ndarray, label: np.ndarray, n_parts: int, rng: np.random.Generator, epochs: int = 12, batch: int = 256):
        d = x.shape[1]
        w = np.zeros((d, n_parts), dtype=np.float32)
        for p in range(n_parts):
            rows = x[label == p]
            if len(rows):
                w[:, p] = rows.mean(axis=0)
        w /= np.maximum(np.linalg.norm(w, axis=0, keepdims=True), 1e-9)
        w *= 12
        b = np.zeros(n_parts, dtype=np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        t = 0
        for epoch in range(epochs):
            rate = 0.1 * (1 - epoch / epochs)
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                p = self._softmax(x[i] @ w + b)
                p[np.arange(len(i)), label[i]] -= 1
                g = x[i].T @ p / len(i) + 1e-5 * w
                t += 1
                m += 0.1 * (g - m)
                v += 0.02 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
                b -= rate * 0.1 * p.mean(axis=0)
        self.w, self.b = w.astype(np.float32), b

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def balance(self, x: np.ndarray, rounds: int = 40) -> Router:
        """Prices in place of biases: crowded parts grow dearer until every part is visited about equally often."""
        z = x @ self.w + self.b
        n_parts = z.shape[1]
        probes = min(MIN_PROBES, n_parts)
        even = max(1.0, len(x) * probes / n_parts)
        for i in range(rounds):
            top = np.argpartition(-z, probes - 1, axis=1)[:, :probes]
            load = np.bincount(top.ravel(), minlength=n_parts) / even
            step = (0.5 / (1 + 0.1 * i) * np.log(np.maximum(load, 0.2))).astype(np.float32)
            z -= step
            self.b = self.b - step
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(x @ self.w + self.b)

    def packed(self) -> tuple[bytes, bytes]:
        return self.w.astype(np.float16).tobytes(), self.b.astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, w: bytes, b: bytes) -> Router:
        out = cls.__new__(cls)
        out.b = np.frombuffer(b, np.float32)
        out.w = np.frombuffer(w, np.float16).reshape(-1, len(out.b)).astype(np.float32)
        return out


def whole_part(dim: int) -> Router:
    """A router of one part."""
    return Router.unpacked(np.zeros(dim, np.float16).tobytes(), np.zeros(1, np.float32).tobytes())


def best_parts(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` most probable parts of every row, best first, with their probabilities."""
    k = min(k, p.shape[1])
    top = np.argpartition(-p, k - 1, axis=1)[:, :k]
    ptop = np.take_along_axis(p, top, axis=1)
    order = np.argsort(-ptop, axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1), np.take_along_axis(ptop, order, axis=1)


def fit_router(x: np.ndarray, n_parts: int, seed: int = 11) -> Router:
    """Router of a sample of unit rows into balanced parts; never more parts than an eighth of the rows."""
    rng = np.random.default_rng(seed)
    n_parts = int(min(n_parts, max(1, len(x) // 8)))
    if n_parts <= 1:
        return Router(x, np.zeros(len(x), dtype=np.int64), 1, rng, epochs=0)
    label = balanced_parts(x, neighbour_graph(x, 10), n_parts, rng)
    return Router(x, label, int(label.max()) + 1, rng).balance(x)


def shape_of(n_rows: int, part_rows: int) -> tuple[int, int]:
    """Levels of the tree and parts of each node for a collection's size."""
    n_parts = max(1, round(n_rows / part_rows))
    levels = 1
    while MAX_BRANCH**levels < n_parts:
        levels += 1
    return levels, int(np.ceil(n_parts ** (1 / levels) - 1e-9))


class Tree:
    """Routers by node, level by level. A node's children are ``node * stride + part``; those of the last level are leaves."""

    def __init__(self, stride: int):
        self.stride = stride
        self.levels: list[dict[int, Router]] = []
        self.rows: list[dict[int, float]] = [{0: 1.0}]  # share of all rows that visit a node

    def down(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The most probable nodes below all levels present: rows, nodes, probabilities."""
        at, node, p = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x))
        for level in self.levels:
            at, node, p = most_probable(*self.below(level, x, at, node, p, beam), beam, beam, 1.0)
        return at, node, p

    def below(self, routers: dict[int, Router], x: np.ndarray, at: np.ndarray, node: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` most probable children of every row's nodes: rows, children, probabilities."""
        parts = []
        for n, rows in _grouped(node):
            top, q = best_parts(routers[n].probabilities(x[at[rows]]), k)
            parts.append((np.repeat(at[rows], top.shape[1]), (n * self.stride + top).ravel(), (p[rows, None] * q).ravel()))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def most_probable(at: np.ndarray, node: np.ndarray, p: np.ndarray, least: int, most: int, cover: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row the most probable nodes: ``least`` of them, and up to ``most`` until they cover enough."""
    order = np.lexsort((node, -p, at))
    at, node, p = at[order], node[order], p[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first = np.repeat(starts, np.diff([*starts, len(at)]))
    rank = np.arange(len(at)) - first
    before = np.cumsum(p) - p
    keep = (rank < least) | (rank < most) & (before - before[first] < cover)
    return at[keep], node[keep], p[keep]


def _grouped(node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(node, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]])) if len(node) else np.empty(0, np.int64)
    for rows in np.split(order, starts[1:]) if len(node) else ():
        yield int(node[rows[0]]), rows


def probes_of(levels: int, probes: int) -> tuple[int, int]:
    """Parts that a vector visits below so many classifiers, at least and at most."""
    return (min(MIN_PROBES, probes), probes) if levels == 1 else (probes * levels, probes * levels)


def _pack(x: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Vectors as 16-bit integers: per row a step width and a binary value. Cosine does not depend on the step."""
    top = np.abs(x).max(axis=1, keepdims=True)
    # a power of two keeps values that are multiples of one exact
    step = np.exp2(np.ceil(np.log2(top / 32767)))
    q = np.rint(x / step).astype(np.int16)
    n, d = q.shape
    width = d * 2
    return q, pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(q.tobytes())])


def _unpack(column: pa.Array, d: int) -> np.ndarray:
    q = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int16).reshape(-1, d)
    return unit_rows(q.astype(np.float32))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, vec`` of the rows whose vector has ``dim`` values, none null or not a number, not all zero."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    some = F.exists(v, lambda y: y != 0)
    return vectors.select(F.col(id_col).cast("string").alias("id"), v.cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & (F.size(v) == dim) & ~bad & some)


def blocks_of(load: float) -> tuple[int, int]:
    """Blocks of index rows and of queries of a part; 1 but for parts far above the usual size."""
    return max(1, int(np.ceil(load / BLOCK_ROWS))), max(1, int(np.ceil(load / (4 * BLOCK_ROWS))))


def _tiles(h: np.ndarray, leaf: np.ndarray, blocks: dict[int, tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Rows, tiles, and whether a row is indexed and asks there; rows of a part of one block have one tile."""
    at, tile, own, ask = [np.arange(len(h))], [np.zeros(len(h), np.int64)], [np.ones(len(h), bool)], [np.ones(len(h), bool)]
    large = np.isin(leaf, list(blocks)) if blocks else np.zeros(len(h), bool)
    if large.any():
        at, tile, own, ask = ([c[0][~large]] for c in (at, tile, own, ask))
        for n, rows in _grouped(leaf[large]):
            rows = np.flatnonzero(large)[rows]
            b, q = blocks[n]
            mine, my_ask = h[rows] % b, (h[rows] >> 20) % q
            for s in range(b):
                for a in range(q):
                    is_own, is_ask = mine == s, my_ask == a
                    here = is_own | is_ask
                    for col, val in ((at, rows[here]), (tile, np.full(here.sum(), s * q + a)), (own, is_own[here]), (ask, is_ask[here])):
                        col.append(val)
    return tuple(np.concatenate(c) for c in (at, tile, own, ask))


def _search(same: np.ndarray, own: np.ndarray, ask: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every asking row of a part the ``k`` nearest other rows indexed there: rows asked, positions (-1: none), cosines."""
    base, queries = np.flatnonzero(own), np.flatnonzero(ask)
    best_s = np.full((len(queries), k), -2.0, np.float32)
    best_i = np.full((len(queries), k), -1, np.int64)
    if not len(base):
        return queries, best_i, best_s
    bv = vec[base]
    place = np.full(len(same), -1)
    place[base] = np.arange(len(base))
    for c in range(0, len(queries), 512):
        q = queries[c : c + 512]
        s = vec[q] @ bv.T
        me = place[q]
        s[np.flatnonzero(me >= 0), me[me >= 0]] = -2
        m = min(k, s.shape[1])
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        sn = np.take_along_axis(s, near, axis=1)
        # the same pair met in two parts has the same score: products of the two rows alone, summed in one order
        exact = np.einsum("ij,ikj->ik", vec[q].astype(np.float64), bv[near].astype(np.float64))
        best_s[c : c + 512, :m] = np.where(sn > -2, np.round(exact, 6), -2)
        best_i[c : c + 512, :m] = np.where(sn > -2, base[near], -1)
    return queries, best_i, best_s


def _sample(rows: DataFrame, n: int, most: float, salt: int) -> DataFrame:
    """About ``most`` of ``n`` rows' distinct vectors, by their hash."""
    share = min(1.0, most / n)
    return rows.where(F.pmod(F.xxhash64("same", F.lit(salt)), F.lit(1_000_003)) < share * 1_000_003).groupBy("same").agg(F.first("vec").alias("vec"))


def _models(rows: DataFrame, n: int, tree: Tree, dim: int, max_sample: int, part_rows: int) -> DataFrame:
    """``node, w, b, loads`` of the level below the tree's: every node fitted on a bounded sample of the rows that visit it."""
    depth, nodes = len(tree.levels), tree.rows[-1]
    picked = _sample(rows, n, max_sample * len(nodes) / 2, depth)
    sent = rows.sparkSession.sparkContext.broadcast(tree)
    visits = sum(nodes.values())
    levels, branch = shape_of(n, part_rows)
    last = depth + 1 == levels

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, node, _ = sent.value.down(unit_rows(_vectors(batch.column(1))), MIN_PROBES)
                yield pa.RecordBatch.from_arrays([pa.array(node), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["node", "same", "vec"])

    def fit(group: pa.Table) -> pa.Table:
        node = group.column("node")[0].as_py()
        x = unit_rows(_vectors(group.column("vec").combine_chunks()))
        order = np.argsort(group.column("same").to_numpy(), kind="stable")[:max_sample]
        x = x[order]
        share = nodes.get(node, 1 / len(nodes))
        # a node's parts follow its share of the rows
        router = fit_router(x, int(max(1, min(tree.stride - 1, np.ceil(branch * share * len(nodes) / visits)))))
        top, _ = best_parts(router.probabilities(x), MIN_PROBES)
        load = np.bincount(top.ravel(), minlength=len(router.b)) / max(1, len(x)) * share
        if last:  # the visits of a search, not of this sample
            load *= n * probes_of(levels, MAX_PROBES)[1] / (MIN_PROBES * visits)
        w, b = router.packed()
        return pa.table({"node": pa.array([node], pa.int64()), "w": pa.array([w], pa.binary()), "b": pa.array([b], pa.binary()), "loads": pa.array([load.tolist()], pa.list_(pa.float64()))})

    return picked.select("same", "vec").mapInArrow(place, "node long, same long, vec array<float>").groupBy("node").applyInArrow(fit, "node long, w binary, b binary, loads array<double>")


def fit_tree(rows: DataFrame, n: int, dim: int, max_sample: int, part_rows: int) -> tuple[Tree, dict[int, Router] | None, dict[int, tuple[int, int]]]:
    """The upper levels, the last level (None where it is too large to be sent), and the parts that need blocks."""
    levels, branch = shape_of(n, part_rows)
    tree = Tree(2 * branch + 2)
    sample = _sample(rows, n, max_sample, 0).select("vec").toArrow().column("vec").combine_chunks()
    x = unit_rows(_vectors(sample) if len(sample) > 1 else np.random.default_rng(0).normal(size=(2, dim)).astype(np.float32))
    root = fit_router(x, branch)
    top, _ = best_parts(root.probabilities(x), MIN_PROBES)
    share = np.bincount(top.ravel(), minlength=len(root.b)) / len(x)
    if levels == 1:
        return tree, {0: root}, {i: blocks_of(s * n) for i, s in enumerate(share) if s * n > BLOCK_ROWS}
    tree.levels.append({0: root})
    tree.rows.append({i: max(s, 1 / len(x)) for i, s in enumerate(share)})
    for depth in range(1, levels):
        last = depth + 1 == levels
        if last and int(branch**levels) * dim * 2 > ROUTER_BYTES:
            return tree, None, {}
        routers, loads = {}, {}
        for r in _models(rows, n, tree, dim, max_sample, part_rows).collect():  # bounded by MAX_BRANCH ** 2 parts or ROUTER_BYTES
            routers[r.node] = Router.unpacked(r.w, r.b)
            loads |= {r.node * tree.stride + i: v for i, v in enumerate(r.loads)}
        empty = [k for k in tree.rows[-1] if k not in routers]  # nodes without a sample have one part
        routers |= {k: whole_part(dim) for k in empty}
        loads |= {k * tree.stride: 0.0 for k in empty}
        if last:
            return tree, routers, {k: blocks_of(v) for k, v in loads.items() if v > BLOCK_ROWS}
        tree.levels.append(routers)
        tree.rows.append({k: max(v, 1e-12) for k, v in loads.items()})
    raise AssertionError("unreachable")


def nearest_vectors(vectors: DataFrame, id_col: str = "id", vec_col: str = "dense", dim: int = DIM, k: int = TOP, max_sample: int = MAX_SAMPLE, part_rows: int = PART_ROWS, probes: int = MAX_PROBES, cover: float = COVER) -> DataFrame:
    """The ``k`` nearest other ids of every id by cosine, approximately.

    Unusable vectors (null, other length, all zero, null or non-finite values) and null ids give no rows; exact
    duplicate rows count once; ids that share a vector are neighbours of cosine 1, ties are taken in the order of
    ids; extra columns are ignored. Result: ``id, neighbour_id, cosine, rank``.

    Copies of a vector form a class. Only classes are routed and searched; of a class no more than its ``k + 1``
    least ids are ever needed, which a group limit picks before the shuffle.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, dim).withColumn("same", F.xxhash64("vec"))
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], "id string, neighbour_id string, cosine double, rank int")
    tree, last, blocks = fit_tree(rows, n, dim, max_sample, part_rows)
    schema = "part long, block int, own boolean, ask boolean, same long, vec binary"

    least, most = probes_of(len(tree.levels) + 1, probes)

    def tiled(at: np.ndarray, leaf: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        row, tile, own, ask = _tiles(h[at], leaf, blocks)
        return at[row], leaf[row], tile, own, ask

    def emit(at: np.ndarray, leaf: np.ndarray, h: np.ndarray, packed: pa.Array) -> pa.RecordBatch:
        at, leaf, tile, own, ask = tiled(at, leaf, h)
        at = pa.array(at)
        return pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(tile.astype(np.int32)), pa.array(own), pa.array(ask), pa.array(h).take(at), packed.take(at)], names=["part", "block", "own", "ask", "same", "vec"])

    def news(batch: pa.RecordBatch, seen: set[int]) -> pa.Array | None:
        new = [i for i, h in enumerate(batch.column(0).to_pylist()) if h not in seen and not seen.add(h)]
        return pa.array(new) if new else None

    distinct = rows.select("same", "vec")
    if last is not None:  # the last level is small enough for every task
        sent = spark.sparkContext.broadcast((tree, last))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            upper, routers = sent.value
            seen: set[int] = set()
            for batch in batches:
                take = news(batch, seen)
                if take is None:
                    continue
                q, packed = _pack(_vectors(batch.column(1).take(take)))
                h, x = batch.column(0).take(take).to_numpy(), unit_rows(q.astype(np.float32))
                found = upper.below(routers, x, *upper.down(x, NODE_BEAM), most)
                at, leaf, _ = most_probable(*found, least, most, cover)
                yield emit(at, leaf, h, packed)

        routed = distinct.mapInArrow(route, schema)
    else:
        sent = spark.sparkContext.broadcast(tree)
        left_out = pa.table({"part": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "own": pa.array([], pa.bool_()), "ask": pa.array([], pa.bool_()), "same": pa.array([], pa.int64()), "vec": pa.array([], pa.binary())})
        salts = max(1, -(-FAR_BEAM * n // (len(tree.rows[-1]) * ROUTED_ROWS)))

        def to_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                take = news(batch, seen)
                if take is None:
                    continue
                q, packed = _pack(_vectors(batch.column(1).take(take)))
                h = batch.column(0).take(take).to_numpy()
                at, node, _ = sent.value.down(unit_rows(q.astype(np.float32)), FAR_BEAM)
                rows_at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((h[at] >> 30) % salts), pa.array(h).take(rows_at), packed.take(rows_at)], names=["node", "salt", "same", "vec"])

        def in_node(_, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return left_out
            left = left.combine_chunks()
            h, packed = left.column("same").to_numpy(), left.column("vec").chunk(0)
            # a node without a sample is one part
            router = Router.unpacked(right.column("w")[0].as_py(), right.column("b")[0].as_py()) if right.num_rows else whole_part(dim)
            at, node = np.arange(len(h)), np.full(len(h), left.column("node")[0].as_py())
            at, leaf, _ = tree.below({int(node[0]): router}, _unpack(packed, dim), at, node, np.ones(len(h)), -(-most // FAR_BEAM))
            return pa.Table.from_batches([emit(at, leaf, h, packed)])

        placed = distinct.mapInArrow(to_nodes, "node long, salt long, same long, vec binary")
        models = _models(rows, n, tree, dim, max_sample, part_rows).select("node", "w", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        routed = placed.groupBy("node", "salt").cogroup(models.groupBy("node", "salt")).applyInArrow(in_node, schema)
    n_leaves = max(1, round(n / part_rows))
    tasks = min(n_leaves, max(2_000, 3 * n * dim * 2 // (64 << 20)))
    routed = routed.repartition(max(tasks, min(n_leaves, spark.sparkContext.defaultParallelism)), "part", "block")

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        same, first, inverse = np.unique(group.column("same").to_numpy(), return_index=True, return_inverse=True)
        own, ask = np.zeros(len(same), bool), np.zeros(len(same), bool)
        np.logical_or.at(own, inverse, group.column("own").to_numpy(zero_copy_only=False).astype(bool))
        np.logical_or.at(ask, inverse, group.column("ask").to_numpy(zero_copy_only=False).astype(bool))
        vec = _unpack(group.column("vec").take(pa.array(first)), dim)
        queries, near, score = _search(same, own, ask, vec, k)
        good = near >= 0
        rows_, cols_ = np.nonzero(good)
        counts = np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32)
        return pa.table({
            "same": pa.array(same[queries]),
            "near": pa.ListArray.from_arrays(pa.array(counts), pa.array(same[near[rows_, cols_]])),
            "score": pa.ListArray.from_arrays(pa.array(counts), pa.array(score[rows_, cols_])),
        })

    found = routed.groupBy("part", "block").applyInArrow(lambda t: search(t), "same long, near array<long>, score array<float>")
    hits = F.flatten(F.collect_list(F.transform(F.arrays_zip("near", "score"), lambda y: F.struct((-y["score"].cast("double")).alias("far"), y["near"].alias("near")))))
    merged = found.groupBy("same").agg(F.slice(F.array_sort(F.array_distinct(hits)), 1, k).alias("hits"))
    # members: the k + 1 least ids of every class, with the class's size up to that
    ids = rows.select("id", "same").distinct()
    low = Window.partitionBy("same").orderBy("id")
    members = ids.withColumn("no", F.row_number().over(low)).where(F.col("no") <= k + 1).groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # classes of more than k copies find all their neighbours inside; smaller ones fill up from other classes
    inside = ids.join(members, "same").select("id", "same", F.slice(F.array_except("ids", F.array("id")), 1, k).alias("ids"))
    within = inside.select("id", F.lit(0.0 - 1.0).alias("far"), F.explode("ids").alias("neighbour_id"))
    small = inside.where(F.size("ids") < k).select("id", "same")
    other = merged.select("same", F.explode("hits").alias("hit")).select("same", "hit.far", F.col("hit.near").alias("near"))
    other = other.join(members.select(F.col("same").alias("near"), "ids"), "near").select("same", "far", F.explode(F.slice("ids", 1, k)).alias("neighbour_id"))
    across = small.join(other, "same").select("id", "far", "neighbour_id")
    best = Window.partitionBy("id").orderBy("far", "neighbour_id")
    both = within.unionByName(across).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("id", "neighbour_id", F.round(-F.greatest("far", F.lit(-1.0)), 6).alias("cosine"), "rank")


def neighbour_pairs(nearest: DataFrame) -> DataFrame:
    """Unordered pairs of which at least one is among the nearest of the other: ``chunk_id_a < chunk_id_b``."""
    return nearest.select(F.least("id", "neighbour_id").alias("chunk_id_a"), F.greatest("id", "neighbour_id").alias("chunk_id_b")).distinct()
