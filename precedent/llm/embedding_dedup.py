"""Near-duplicate vectors by an epsilon grid order join.

Cosine >= t between unit vectors is a Euclidean distance of at most
eps = sqrt(2 - 2t). Vectors are projected on their leading principal
dimensions, laid on a grid of cell width eps there, and sorted by cell in
lexicographic order. The sequence is cut into intervals of about INTERVAL
vectors (a cell that alone holds more is dealt over several); two intervals meet
only if their boxes in the leading dimensions are no further apart than eps.
Inside a task a pair of intervals is joined recursively: halves whose boxes are
further apart than eps are skipped, and leaves are compared by a matrix product
in single precision, with all cosines near the threshold decided in double.

Equal vectors are one class with a weight; classes are never expanded. A task
returns link counts per class and a forest of its links, never the pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import join_groups, save
from precedent.llm.components import components

INTERVAL = 4096
LEAF = 512
DIMS = 8  # leading dimensions of the grid
BOX = 16  # leading dimensions of the boxes


def _vectors(batches):
    """vec_id, cls (digest; null if the vector can link with nothing), dim, vec."""
    for b in batches:
        col = b.column(1)
        off = np.asarray(col.offsets).astype(np.int64)
        flat = col.values
        gaps = np.asarray(flat.is_null())
        x = np.asarray(flat.fill_null(0)).astype(np.float64) + 0.0
        bad = np.concatenate([[0], np.cumsum(gaps | ~np.isfinite(x))])
        ok = ~np.asarray(col.is_null()) & ~np.asarray(b.column(0).is_null()) & (bad[off[1:]] == bad[off[:-1]])
        cls, vec, dim = [], [], (off[1:] - off[:-1]).astype(np.int32)
        for i, good in enumerate(ok.tolist()):
            v = x[off[i] : off[i + 1]]
            good = good and v.any()
            vec.append(v.tobytes() if good else None)
            cls.append(hashlib.blake2b(vec[-1], digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array(dim),
                                          pa.array(vec, pa.binary())], ["vec_id", "cls", "dim", "vec"])


def _matrix(values, dim) -> np.ndarray:
    """Unit vectors, in double; scaled first so that no square over- or underflows."""
    x = np.frombuffer(b"".join(values), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(dim):
    def run(batches):
        n, first, second = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0).to_pylist(), dim)
                n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        every = np.concatenate([[n], first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every))), pa.array(every)], ["i", "v"])

    return run


def principal(nodes: DataFrame, dim: int) -> np.ndarray:
    """Mean-free principal directions (dim x dim, leading first), from sums over
    all vectors."""
    got = nodes.select("vec").mapInArrow(_moments(dim), "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    v = np.array([r["v"] for r in sorted(got.collect())])
    n, mean, second = v[0], v[1 : dim + 1] / v[0], v[dim + 1 :].reshape(dim, dim) / v[0]
    return np.linalg.eigh(second - np.outer(mean, mean))[1][:, ::-1].copy()


def _order(x, axes, eps):
    """Place in the epsilon grid order as one number."""
    bits = max(2, math.ceil(math.log2(2 / eps + 2)) + 1)
    m = max(1, min(axes.shape[1], DIMS, 62 // bits))
    cells = np.floor((x @ axes[:, :m] + 1) / eps).astype(np.int64) + 1
    out = np.zeros(len(x), np.int64)
    for j in range(m):
        out = (out << bits) | np.clip(cells[:, j], 0, (1 << bits) - 1)
    return out


def _with_order(dim, axes, eps):
    def run(batches):
        for b in batches:
            ego = _order(_matrix(b.column(2).to_pylist(), dim), axes, eps) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ego)], [*b.schema.names, "ego"])

    return run


def _pieces(dim, axes):
    """Rows come sorted by (piece, ego): one row per piece, with its box."""

    def row(piece, parts):
        ids, sizes, vec = (np.concatenate([p[k] for p in parts]) for k in range(3))
        p = _matrix([vec.tobytes()], dim) @ axes[:, : min(BOX, dim)]
        return pa.RecordBatch.from_arrays(
            [pa.array([piece]), pa.array([ids.tobytes()]), pa.array([sizes.tobytes()]), pa.array([vec.tobytes()]),
             pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()])],
            ["piece", "ids", "sizes", "vecs", "lo", "hi"])

    def run(batches):
        last, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            at = np.asarray(b.column(0))
            edge = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            cols = [np.asarray(b.column(1)), np.asarray(b.column(2)),
                    np.frombuffer(b"".join(b.column(3).to_pylist()), np.float64).reshape(-1, dim)]
            for i, j in zip(edge, edge[1:]):
                if parts and at[i] != last:
                    yield row(last, parts)
                    parts = []
                last = int(at[i])
                parts.append([c[i:j] for c in cols])
        if parts:
            yield row(last, parts)

    return run


def _forest(a, b, n):
    """Links (x, smallest) that connect what the links a-b connect, of n nodes."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all():
            x = np.flatnonzero(lab != np.arange(n))
            return x, lab[x]
        lab = new


def _joined(dim, axes, eps, t):
    """Rows hold two pieces: emit (node, other, links): link counts (other null)
    and a forest of the links."""
    lead = axes[:, : min(BOX, dim)]

    def join(x, wx, y, wy, same):
        nx, x32, y32, px, py = len(x), x.astype(np.float32), y.astype(np.float32), x @ lead, y @ lead
        links_x, links_y = np.zeros(nx, np.int64), np.zeros(len(y), np.int64)
        got_a, got_b = [], []

        def distant(i0, i1, j0, j1):
            gap = np.maximum(0, np.maximum(px[i0:i1].min(axis=0) - py[j0:j1].max(axis=0),
                                           py[j0:j1].min(axis=0) - px[i0:i1].max(axis=0)))
            return gap @ gap > eps * eps + 1e-9

        def leaf(i0, i1, j0, j1):
            g = x32[i0:i1] @ y32[j0:j1].T
            if same and i0 == j0:
                g[np.tril_indices(len(g))] = -2
            p, q = np.nonzero(g >= t - 1e-4)
            if not len(p):
                return
            near = np.flatnonzero(g[p, q] < t + 1e-4)
            if len(near):
                keep = np.ones(len(p), bool)
                for s in range(0, len(near), 1 << 15):
                    k = near[s : s + (1 << 15)]
                    keep[k] = np.einsum("ij,ij->i", x[i0 + p[k]], y[j0 + q[k]]) >= t
                p, q = p[keep], q[keep]
            links_x[i0:i1] += np.bincount(p, wy[j0 + q], i1 - i0).astype(np.int64)
            links_y[j0:j1] += np.bincount(q, wx[i0 + p], j1 - j0).astype(np.int64)
            a, b = _forest(p, q + len(g), len(g) + g.shape[1])
            at = np.concatenate([np.arange(i0, i1), np.arange(j0, j1) + nx])
            got_a.append(at[a])
            got_b.append(at[b])

        stack = [(0, nx, 0, len(y))]
        while stack:
            i0, i1, j0, j1 = stack.pop()
            if i0 >= i1 or j0 >= j1 or same and i0 > j0 or distant(i0, i1, j0, j1):
                continue
            if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
                leaf(i0, i1, j0, j1)
                continue
            i, j = (i0 + i1) // 2, (j0 + j1) // 2
            if not same and i1 - i0 <= LEAF:
                stack += [(i0, i1, j0, j), (i0, i1, j, j1)]
            elif not same and j1 - j0 <= LEAF:
                stack += [(i0, i, j0, j1), (i, i1, j0, j1)]
            else:
                stack += [(i0, i, j0, j), (i0, i, j, j1), (i, i1, j0, j), (i, i1, j, j1)]
        none = np.zeros(0, np.int64)
        return links_x, links_y, np.concatenate([none, *got_a]), np.concatenate([none, *got_b])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                pa_, pb, ids_a, w_a, v_a, ids_b, w_b, v_b = (c[r].as_py() for c in batch.columns)
                ia, wa, ib, wb = (np.frombuffer(v, np.int64) for v in (ids_a, w_a, ids_b, w_b))
                same = pa_ == pb
                x = _matrix([v_a], dim)
                y = x if same else _matrix([v_b], dim)
                lx, ly, a, b = join(x, wa, y, wb, same)
                ids = np.concatenate([ia, ib])
                node, links = np.concatenate([ia, ib]), np.concatenate([lx, ly])
                hit = np.flatnonzero(links)
                node, links = node[hit], links[hit]
                other = pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(ids[b])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node, ids[a]])), other,
                     pa.array(np.concatenate([links, np.zeros(len(a), np.int64)]))], ["node", "other", "links"])

    return run


def _links(nodes: DataFrame, dim: int, n: int, t: float, interval: int) -> DataFrame:
    """node, other, links of all classes of one dimension."""
    eps = math.sqrt(max(2 - 2 * t, 1e-12))
    axes = principal(nodes, dim)
    placed = save(nodes.select("node", "size", "vec").mapInArrow(
        _with_order(dim, axes, eps), "node long, size long, vec binary, ego long"), "grid-order")
    count = max(1, -(-n // interval))
    edges = placed.approxQuantile("ego", [k / count for k in range(1, count)], 0.2 / count) if count > 1 else []
    edges = np.unique(np.array(edges, np.int64))

    def cut(batches):
        for b in batches:
            yield b.append_column("seq", pa.array(np.searchsorted(edges, np.asarray(b.column(3)), "right")))

    placed = placed.mapInArrow(cut, "node long, size long, vec binary, ego long, seq long")
    sizes = placed.groupBy("seq").agg(F.ceil(F.count(F.lit(1)) / interval).alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "seq")  # one row per interval
    piece = F.xxhash64("seq", F.pmod(F.xxhash64("node"), F.col("parts")))
    pieces = save(dealt.select(piece.alias("piece"), "node", "size", "vec", "ego").repartition("piece")
                  .sortWithinPartitions("piece", "ego").select("piece", "node", "size", "vec").mapInArrow(
                      _pieces(dim, axes), "piece long, ids binary, sizes binary, vecs binary, lo array<double>, hi array<double>"),
                  "intervals")
    low, high = F.floor((F.col("lo")[0] + 2) / eps), F.floor((F.col("hi")[0] + 2) / eps)
    box = pieces.select("piece", "lo", "hi", low.alias("c0"), high.alias("c1"))
    left = box.select(F.col("piece").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
                      F.explode(F.sequence("c0", F.col("c1") + 1)).alias("cell"))
    right = box.select(F.col("piece").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
                       F.explode(F.sequence("c0", F.col("c1") + 1)).alias("cell"))
    gap = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y),
                     lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    pairs = left.join(right, "cell").where(F.col("a") <= F.col("b")).where(apart <= eps * eps + 1e-9).select("a", "b").distinct()
    side = lambda c: pieces.select(F.col("piece").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("ids", "sizes", "vecs")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "ids_a", "sizes_a", "vecs_a", "ids_b", "sizes_b", "vecs_b")
    return both.mapInArrow(_joined(dim, axes, eps, t), "node long, other long, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                 interval: int = INTERVAL) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows with cosine >=
    threshold), component_id (smallest id reachable), kept (vec_id =
    component_id).

    Vectors that are null, empty, zero, or hold a null or non-finite component
    link with nothing, and so do rows with a null id (which stay, with a null
    component_id); vectors of different lengths never link. Rows repeated with
    one id count as other vectors in n_links. ``threshold`` must be above 0.
    Other columns are not read; an empty table gives an empty result."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = save(src.mapInArrow(_vectors, "vec_id long, cls binary, dim int, vec binary"), "vectors")
    classes = save(rows.where("cls is not null").groupBy("cls").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")), "vector-classes")
    reps = save(rows.join(classes.select("cls", F.col("rep").alias("vec_id"), "size"), ["cls", "vec_id"])
                .dropDuplicates(["cls"]).select(F.col("vec_id").alias("node"), "size", "dim", "vec"), "vector-reps")
    found = None
    for r in sorted(reps.groupBy("dim").count().collect()):
        own = _links(reps.where(F.col("dim") == r["dim"]), r["dim"], r["count"], threshold, interval)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = reps.sparkSession.createDataFrame([], "node long, other long, links long")
    found = save(found, "vector-links")
    n_links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    whole = save(classes.join(n_links.withColumnRenamed("node", "rep"), "rep", "left")
                 .join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
                     "cls", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")), "vector-components")
    slim = rows.select("vec_id", "cls")
    out = join_groups(slim.where("cls is not null"), whole, "cls", "size").select("vec_id", "n_links", "component_id")
    alone = slim.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
