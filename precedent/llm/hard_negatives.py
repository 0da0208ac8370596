"""Hard negatives by a multiway hyperplane tree (GNAT) with stored distance ranges.

An anchor's positives are the rows of its label with the highest inner products;
a positive's hard negatives are the rows of other labels whose score lies in a
window just below the positive's. Both are searches for the best rows within a
window of scores. Rows are lifted to one length R (the largest of all) by one
more component, so that a score s of the anchor q is the distance
sqrt(|q|^2 + R^2 - 2 s), and a window of scores is an annulus around q.

The tree has two levels. Each inner node has up to FANOUT split points, far apart,
and a row belongs to the nearest one. A node stores, for each split point i and
each subtree j, the least and largest distance from i to the rows of j. From an
anchor's distance to i these ranges bound its distance to all rows of j; j is
skipped if any i puts it outside the annulus. Split points come from a sample of
at most SAMPLE rows; every row is in a leaf, and ranges hold over all rows, so no
row is lost.

A leaf's rows lie in pieces of about PIECE rows. Anchors, packed by leaf, are sent
to the pieces of the leaves that they cannot skip and joined by piece; a tile of
anchors and rows is one matrix product. Each search goes twice: through the
anchor's own leaf, whose finds narrow the window, and through what then remains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precedent.llm.common import save

#: Rows from which split points are taken, and most children of a node.
SAMPLE = 16_384
FANOUT = 64
#: Rows that a leaf is meant to have, rows in a piece, anchors packed together.
LEAF = 1024
PIECE = 2048
BLOCK = 512
#: Squared lengths stay below it: then scores are exact in double, and a score and
#: a place in a piece fit into one 64-bit number.
LONGEST = 1 << 48
_NONE = -(1 << 62)


def _whole(scale: int):
    """row, id, label, anchor, vec (int32 components), sq; only rows that take part."""

    def run(batches):
        for b in batches:
            col = b.column(4)
            off = np.asarray(col.offsets).astype(np.int64)
            gaps = np.asarray(col.values.is_null())
            x = np.asarray(col.values.fill_null(0)).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(gaps | ~np.isfinite(x))])
            ok = ~np.asarray(col.is_null()) & (bad[off[1:]] == bad[off[:-1]]) & (off[1:] > off[:-1])
            at, vec, sq = [], [], []
            for i in np.flatnonzero(ok).tolist():
                v = np.floor(scale * x[off[i] : off[i + 1]])
                if (length := float(v @ v)) < LONGEST:
                    at.append(i)
                    vec.append(v.astype(np.int32).tobytes())
                    sq.append(int(length))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in b.columns[:4]], pa.array(vec, pa.binary()),
                                              pa.array(sq, pa.int64())], ["row", "id", "label", "anchor", "vec", "sq"])

    return run


def _matrix(values, dim: int) -> np.ndarray:
    """Whole vectors in double; shorter ones end in zeros."""
    size = 4 * dim
    return np.frombuffer(b"".join(v if len(v) == size else v.ljust(size, b"\0") for v in values), np.int32).reshape(-1, dim).astype(np.float64)


def _narrow(x: np.ndarray) -> bytes:
    """Whole components, in two bytes each if all of them fit and else in four: anchors go
    to many pieces, so most of the shuffle is vectors."""
    return x.astype(np.int16 if x.min() >= -(1 << 15) and x.max() < 1 << 15 else np.int32).tobytes()


def _wide(data, n: int, dim: int) -> np.ndarray:
    """``n`` vectors packed by ``_narrow``, in double."""
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * dim else np.int32).reshape(n, dim).astype(np.float64)


class Tree:
    """Split points of the root and its children, with ranges over all rows."""

    def __init__(self, sample: np.ndarray, dim: int, top: int, fanout: int):
        self.dim, self.top, self.k = dim, float(top), fanout
        self.slack = 1e-6 * (1 + np.sqrt(self.top))
        points = self.lift(sample)
        self.splits = [self._split(points)]
        near = self.distances(points, 0).argmin(axis=1)
        for j in range(fanout):
            own = points[near == j]
            self.splits.append(self._split(own if len(own) else points[:1]))
        self.lo = np.full((fanout + 1, fanout, fanout), np.inf)
        self.hi = np.full((fanout + 1, fanout, fanout), -np.inf)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))])

    def _split(self, points: np.ndarray) -> np.ndarray:
        """Points far from each other, out of three times as many; unused places are NaN."""
        some = points[:: max(1, len(points) // (3 * self.k))]
        out, far = np.full((self.k, self.dim + 1), np.nan), np.full(len(some), np.inf)
        at = 0
        for i in range(min(self.k, len(some))):
            out[i] = some[at]
            far = np.minimum(far, np.linalg.norm(some - some[at], axis=1))
            at = int(far.argmax())
            if far[at] <= self.slack:
                break
        return out

    def distances(self, points: np.ndarray, node: int) -> np.ndarray:
        """To the split points of a node; infinite to unused places."""
        p = self.splits[node]
        d = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", p, p)[None, :] - 2 * points @ p.T
        return np.where(np.isnan(d), np.inf, np.sqrt(np.maximum(d, 0)))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        points = self.lift(x)
        child, leaf = self.distances(points, 0).argmin(axis=1), np.zeros(len(x), np.int64)
        for j in np.unique(child).tolist():
            at = np.flatnonzero(child == j)
            leaf[at] = j * self.k + self.distances(points[at], j + 1).argmin(axis=1)
        return leaf

    def watch(self, x: np.ndarray, leaf: np.ndarray) -> None:
        """Ranges take in rows that lie in the given leaves."""
        points = self.lift(x)
        d, child = self.distances(points, 0), leaf // self.k
        for j in np.unique(child).tolist():
            at = np.flatnonzero(child == j)
            self._watch(0, j, d[at])
            e, own = self.distances(points[at], j + 1), leaf[at] % self.k
            for i in np.unique(own).tolist():
                self._watch(j + 1, i, e[own == i])

    def _watch(self, node: int, j: int, d: np.ndarray) -> None:
        self.lo[node, :, j] = np.minimum(self.lo[node, :, j], d.min(axis=0))
        self.hi[node, :, j] = np.maximum(self.hi[node, :, j], d.max(axis=0))

    def _kept(self, d: np.ndarray, node: int, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """[anchor, subtree]: whether an annulus of the anchor meets the subtree."""
        used = ~np.isnan(self.splits[node][:, 0])
        d, lo, hi = d[:, used, None], self.lo[node][used], self.hi[node][used]
        least = np.maximum(lo[None] - d, d - hi[None]).max(axis=1)  # infinite for an empty subtree
        most = (d + hi[None]).min(axis=1)
        return ((least[:, :, None] <= outer[:, None, :] + self.slack) & (most[:, :, None] >= inner[:, None, :] - self.slack)).any(axis=2)

    def leaves(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[anchor, leaf]: leaves that may hold scores in one of the anchor's windows
        low <= s <= high (both [anchor, window])."""
        sq = np.einsum("ij,ij->i", x, x)[:, None] + self.top
        inner, outer = (np.sqrt(np.maximum(sq - 2.0 * s, 0)) for s in (np.minimum(high, sq), low))
        none = low > high
        inner, outer = np.where(none, np.inf, inner), np.where(none, -np.inf, outer)
        points = np.column_stack([x, np.zeros(len(x))])
        out = np.zeros((len(x), self.k * self.k), bool)
        for j, met in enumerate(self._kept(self.distances(points, 0), 0, inner, outer).T):
            if len(at := np.flatnonzero(met)):
                out[at, j * self.k : (j + 1) * self.k] = self._kept(self.distances(points[at], j + 1), j + 1, inner[at], outer[at])
        return out


def _placed(tree: Tree):
    """Adds the leaf to rows whose last column is vec."""

    def run(batches):
        for b in batches:
            leaf = tree.place(_matrix(b.column(b.num_columns - 1).to_pylist(), tree.dim)) if b.num_rows else np.zeros(0, np.int64)
            yield b.append_column("leaf", pa.array(leaf))

    return run


def _ranges(tree: Tree):
    """Least and largest distances, and rows per leaf, that a task has seen: (kind, at,
    lo, hi, n)."""

    def run(batches):
        count = np.zeros(tree.k * tree.k, np.int64)
        tree.lo.fill(np.inf)
        tree.hi.fill(-np.inf)
        for b in batches:
            if b.num_rows:
                leaf = np.asarray(b.column(1))
                tree.watch(_matrix(b.column(0).to_pylist(), tree.dim), leaf)
                count += np.bincount(leaf, minlength=len(count))
        lo, hi = tree.lo.ravel(), tree.hi.ravel()
        seen, own = np.flatnonzero(np.isfinite(lo)), np.flatnonzero(count)
        for kind, at, least, most, n in ((0, seen, lo[seen], hi[seen], 0 * seen), (1, own, 0.0 * own, 0.0 * own, count[own])):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(len(at), kind), at, least, most, n)], ["kind", "at", "lo", "hi", "n"])

    return run


def build_tree(rows: DataFrame, dim: int, top: int, n: int, sample: int = SAMPLE, leaf: int = LEAF,
               fanout: int = FANOUT) -> tuple[Tree, DataFrame, np.ndarray]:
    """The tree of saved ``rows``, the rows with their leaves (a saved table: a row near
    the middle of two split points is placed once and for all), and the rows per leaf.
    The driver holds the sample and the ranges: at most fanout^3 + fanout^2 pairs,
    whatever the table."""
    k = int(min(fanout, max(2, np.ceil(np.sqrt(n / leaf)))))
    order = F.xxhash64("row")
    some = rows.select(order.alias("h"), "row", "vec")
    if n > 8 * sample:
        some = some.where(F.pmod("h", F.lit(n // (2 * sample))) == 0)
    tree = Tree(_matrix([r["vec"] for r in some.orderBy("h", "row").limit(sample).collect()], dim), dim, top, k)
    placed = save(rows.select("row", "id", "label", "anchor", "vec").mapInArrow(
        _placed(tree), "row long, id long, label long, anchor boolean, vec binary, leaf long"), "negative-leaves")
    seen = placed.select("vec", "leaf").mapInArrow(_ranges(tree), "kind long, at long, lo double, hi double, n long")
    size = np.zeros(k * k, np.int64)
    for r in seen.groupBy("kind", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toLocalIterator():
        if r["kind"]:
            size[r["at"]] = r["n"]
        else:
            tree.lo.reshape(-1)[r["at"]], tree.hi.reshape(-1)[r["at"]] = r["lo"], r["hi"]
    return tree, placed, size


def _packed(dim: int):
    """Rows come sorted by (piece, id, row): one row a piece."""

    def row(piece, parts):
        cols = [np.concatenate([p[k] for p in parts]) for k in range(4)]
        cols = [*[c.tobytes() for c in cols[:3]], _narrow(cols[3])]
        return pa.RecordBatch.from_arrays([pa.array([piece]), *[pa.array([c], pa.binary()) for c in cols]],
                                          ["piece", "rows", "ids", "labels", "vecs"])

    def run(batches):
        last, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            at = np.asarray(b.column(0))
            cols = [np.asarray(b.column(k)) for k in (1, 2, 3)] + [_matrix(b.column(4).to_pylist(), dim).astype(np.int32)]
            edge = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for i, j in zip(edge, edge[1:]):
                if parts and at[i] != last:
                    yield row(last, parts)
                    parts = []
                last = int(at[i])
                parts.append([c[i:j] for c in cols])
        if parts:
            yield row(last, parts)

    return run


def _visits(tree: Tree, first: np.ndarray, parts: np.ndarray, own: bool, block: int):
    """Packs anchors for each piece that they visit: those of their own leaf, or those
    of all others that they cannot skip. Columns of anchors: row, id, label, leaf, vec,
    lo, hi."""

    def send(held):
        row, ids, label, leaf = (np.concatenate([h[k] for h in held]) for k in range(4))
        x, lo, hi = (np.concatenate([h[k] for h in held]) for k in (4, 5, 6))
        if own:
            go = np.zeros((len(row), tree.k * tree.k), bool)
        else:
            go = tree.leaves(x, lo.astype(np.float64), hi.astype(np.float64))
        go[np.arange(len(row)), leaf] = own
        for at in np.flatnonzero(go.any(axis=0)).tolist():
            i = np.flatnonzero(go[:, at])
            cols = [*[c[i].tobytes() for c in (row, ids, label)], _narrow(x[i]), *[c[i].tobytes() for c in (lo, hi)]]
            for piece in range(int(first[at]), int(first[at] + parts[at])):
                yield pa.RecordBatch.from_arrays([pa.array([piece]), *[pa.array([c], pa.binary()) for c in cols]],
                                                 ["piece", "a_rows", "a_ids", "a_labels", "a_vecs", "lo", "hi"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, block):
                s = b.slice(i, block)
                lists = [np.asarray(s.column(k).flatten()).reshape(s.num_rows, -1) for k in (5, 6)]
                held.append([*[np.asarray(s.column(k)) for k in range(4)], _matrix(s.column(4).to_pylist(), tree.dim), *lists])
                n += s.num_rows
                if n >= block:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    return run


def _tiles(dim: int, k: int, same: bool):
    """The best k rows of a piece for each window of each anchor sent to it: (a_row,
    a_id, window, row, id, score)."""
    names = ["a_row", "a_id", "win", "row", "id", "score"]

    def tile(b, r):
        get = lambda c, kind: np.frombuffer(b.column(c)[r].as_buffer(), kind)
        a_row, a_id, a_label = (get(c, np.int64) for c in (1, 2, 3))
        row, ids, label = (get(c, np.int64) for c in (7, 8, 9))
        lo, hi = (get(c, np.int64).reshape(len(a_row), -1) for c in (5, 6))
        x, y = (_wide(b.column(c)[r].as_buffer(), n, dim) for c, n in ((4, len(a_row)), (10, len(row))))
        s = (x @ y.T).astype(np.int64)
        fit = (s >= lo.min(axis=1)[:, None]) & (s <= hi.max(axis=1)[:, None])
        fit &= (a_label[:, None] == label[None, :]) == same
        fit &= a_row[:, None] != row[None, :]
        p, q = np.nonzero(fit)  # rows lie in the order of their ids
        score = s[p, q]
        order = np.lexsort((q, -score, p))
        p, q, score = p[order], q[order], score[order]
        for w in range(lo.shape[1]):
            at = np.flatnonzero((score >= lo[p, w]) & (score <= hi[p, w]))
            if not len(at):
                continue
            # the first k of each anchor
            start = np.flatnonzero(np.concatenate([[True], p[at][1:] != p[at][:-1]]))
            place = np.arange(len(at)) - np.repeat(start, np.diff([*start, len(at)]))
            at = at[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
                a_row[p[at]], a_id[p[at]], np.full(len(at), w, np.int64), row[q[at]], ids[q[at]], score[at])], names)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                yield from tile(b, r)

    return run


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, neither of which is broadcast. Spark
    judges them by their files and by fixed sizes of binary values: pieces of vectors that
    compress well pass for a small table, and would be gathered whole in the driver."""
    return left.join(right.hint("merge"), on, how)


class Searcher:
    """Exact best rows within windows of scores, over saved rows (row, id, label, anchor,
    vec, sq)."""

    def __init__(self, rows: DataFrame, piece: int = PIECE, block: int = BLOCK, sample: int = SAMPLE, leaf: int = LEAF):
        n, top, size = rows.agg(F.count(F.lit(1)), F.max("sq"), F.max(F.octet_length("vec"))).first()
        self.n, self.dim, self.block = n, (size or 0) // 4, block
        if not n:
            return
        self.tree, placed, count = build_tree(rows, self.dim, top, n, sample, leaf)
        self.parts = -(-count // piece)
        self.first = np.concatenate([[0], np.cumsum(self.parts)[:-1]])
        leaves = placed.sparkSession.createDataFrame(
            list(zip(range(len(count)), self.first.tolist(), np.maximum(self.parts, 1).tolist())), "leaf long, first long, parts long")
        dealt = placed.join(F.broadcast(leaves), "leaf")  # at most FANOUT ^ 2 rows
        self.pieces = save(dealt.select((F.col("first") + F.col("row") % F.col("parts")).alias("piece"), "row", "id", "label", "vec")
                           .repartition("piece").sortWithinPartitions("piece", "id", "row").mapInArrow(
                               _packed(self.dim), "piece long, rows binary, ids binary, labels binary, vecs binary"), "pieces")
        self.anchors = placed.where("anchor").select("row", "id", "label", "leaf", "vec")

    def visits(self, windows: DataFrame, own: bool) -> DataFrame:
        """Anchors (with lo and hi, an array<long> each) packed for the pieces they visit."""
        by_leaf = windows.select("row", "id", "label", "leaf", "vec", "lo", "hi").repartitionByRange("leaf", "row").sortWithinPartitions("leaf", "row")
        return by_leaf.mapInArrow(_visits(self.tree, self.first, self.parts, own, self.block),
                                  "piece long, a_rows binary, a_ids binary, a_labels binary, a_vecs binary, lo binary, hi binary")

    def _pass(self, windows: DataFrame, k: int, same: bool, own: bool) -> DataFrame:
        tiles = _merged(self.visits(windows, own), self.pieces, "piece").select(
            "piece", "a_rows", "a_ids", "a_labels", "a_vecs", "lo", "hi", "rows", "ids", "labels", "vecs")
        return tiles.mapInArrow(_tiles(self.dim, k, same), "a_row long, a_id long, win long, row long, id long, score long")

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("a_row", "win").orderBy(F.desc("score"), "id", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(a_row, a_id, win, row, id, score, rank): the first k rows of each window, of the
        anchor's label (``same``) or of others, the anchor itself left out; a saved table."""
        windows = save(windows, "windows")
        near = save(self._best(self._pass(windows, k, same, own=True), k), "own-leaf")
        full = near.where(F.col("rank") == k).groupBy(F.col("a_row").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("kth"))
        narrow = F.transform("lo", lambda v, i: F.greatest(v, F.element_at("kth", i.cast("long"))))
        rest = _merged(windows, full, "row", "left").withColumn("lo", F.when(F.col("kth").isNull(), F.col("lo")).otherwise(narrow))
        both = near.drop("rank").unionByName(self._pass(rest, k, same, own=False))
        return save(self._best(both, k), "found")


def mine_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
                   piece: int = PIECE, block: int = BLOCK, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    row for which ``anchor`` holds and each of its first ``n_positives`` other rows of the
    same label, the first ``n_negatives`` rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score.

    A component x counts as floor(scale * x), a score is the inner product of whole
    components; higher scores come first, then smaller ids. Rows take no part if id, label
    or vector is null, the vector is empty, a component is null or not finite, or the
    squared length in whole components reaches 2^48. A shorter vector counts as ending in
    zeros. Rows repeated with one id are different rows. Other columns are not read; an
    empty table gives an empty result."""
    if min(n_positives, n_negatives, piece, block, leaf) < 1 or piece > 8192 or sample < 2:
        raise ValueError("counts must be at least 1, a piece at most 8192 rows, a sample at least 2")
    src = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                         F.xxhash64(F.col(label_col).cast("string")).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
                         F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).isNotNull().alias("has"))
    src = src.where("has and id is not null").drop("has")
    rows = save(src.mapInArrow(_whole(scale), "row long, id long, label long, anchor boolean, vec binary, sq long"), "negative-rows")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = Searcher(rows, piece, block, sample, leaf)
    if not found.n:
        return rows.sparkSession.createDataFrame([], schema)
    bound = lambda v: F.array(F.lit(v).cast("long"))
    positives = found.search(found.anchors.withColumn("lo", bound(_NONE)).withColumn("hi", bound(-_NONE)), n_positives, same=True)
    mine = positives.groupBy(F.col("a_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    # each positive opens a window; an anchor with fewer has closed ones
    score = lambda i: F.get(F.col("p"), F.lit(i))["score"]
    down = lambda v: F.call_function("div", v - F.pmod(v, F.lit(100)), F.lit(100))
    or_else = lambda v, x: F.coalesce(v, F.lit(x).cast("long"))
    windows = _merged(found.anchors, mine, "row").select(
        "row", "id", "label", "leaf", "vec",
        F.array(*[or_else(-down(-score(i) * low), 1) for i in range(n_positives)]).alias("lo"),
        F.array(*[or_else(down(score(i) * high), 0) for i in range(n_positives)]).alias("hi"))
    negatives = found.search(windows, n_negatives, same=False)
    left = positives.select("a_row", (F.col("rank") - 1).cast("long").alias("win"), F.col("id").alias("positive_id"),
                            F.col("score").alias("positive_score"))
    return _merged(negatives.withColumnRenamed("score", "negative_score"), left, ["a_row", "win"]).select(
        F.col("a_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", "negative_score")
