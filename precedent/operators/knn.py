"""Exact nearest-neighbour search of a query table against a case table.

Plan shape (no cross join, no pair explosion, no query row on the driver):

  queries --numbered by group g of at most a block, sent to each case shard s--+
  cases   --dealt to a shard s by id, sent to each query group g---------------+
     --partition (g, s), queries first--> mapInArrow: the group's queries are
       held, the shard's cases stream past in Arrow batches; numpy block products,
       of which only pairs within the running k-th distance are measured and ranked
     --shuffle on query--> row_number <= k (WindowGroupLimit)

A query table within ``broadcast_rows`` is broadcast instead, after a count of its
rows and bytes, and the cases are scanned without a shuffle. Both ways run the same
code in the tasks: queries and cases meet by vector length, and on a filtered
route a tile holds the cases and the queries of one label only. Ids may be
integers or text and keep their kind. Ranking order is (distance, id); distances
of kept candidates are recomputed directly from the difference so near-ties rank
the same way as a plain per-pair evaluation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from precedent.session import spread

METRICS = ("sql2", "cosine")

# Bounds on the queries that a task holds (rows and bytes of float64 vectors), on
# those of a table that is broadcast, and on the cases of a shard.
MAX_BLOCK_ROWS = 65536
MAX_BLOCK_BYTES = 128 << 20
MAX_BROADCAST_ROWS = 4096
MAX_BROADCAST_BYTES = 32 << 20
SHARD_ROWS = 4_000_000
# Tile sizes inside a task: the distance tile is CASE_TILE x QUERY_TILE doubles.
CASE_TILE = 2048
QUERY_TILE = 512
# The first cases that a query meets are ranked whole; so many, that later ones are few.
FIRST_TILE = 512
_EPS = 1e-9
# Rounding of a product, as a share of the squared lengths.
_ROUNDING = 1e-13
# Rounding of a float32, as a share of it.
_SINGLE = 2.0**-24
# A query with more than k + FEW near cases in a tile is ranked over the whole tile.
FEW = 32


@dataclass(frozen=True)
class Route:
    """One retrieval route: top-``k`` among cases whose ``case_col`` equals the
    query's ``query_col`` (both None: no filter)."""

    k: int
    case_col: str | None = None
    query_col: str | None = None

    @property
    def filtered(self) -> bool:
        return self.case_col is not None


def _by_length(arr) -> list[tuple[np.ndarray, np.ndarray]]:
    """list<float> Arrow column -> (row numbers, float64 matrix) per vector length.
    Null and empty rows and rows with null or non-finite elements are left out."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    lens = arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == dim)
        sub = arr if len(rows) == len(arr) else arr.take(pa.array(rows))
        mat = sub.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        ok = np.isfinite(mat).all(axis=1)
        out.append((rows, mat) if ok.all() else (rows[ok], mat[ok]))
    return out


def _pair_distance(c: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Direct distance of row-aligned pairs (..., d) x (..., d)."""
    if metric == "sql2":
        diff = c - q
        return np.einsum("...d,...d->...", diff, diff)
    dot = np.einsum("...d,...d->...", c, q)
    return 1.0 - dot / (np.sqrt(np.einsum("...d,...d->...", c, c)) * np.sqrt(np.einsum("...d,...d->...", q, q)))


def _block_distance(c: np.ndarray, q: np.ndarray, cn2: np.ndarray, qn2: np.ndarray, metric: str) -> np.ndarray:
    g = c @ q.T
    if metric == "sql2":
        d = cn2[:, None] + qn2[None, :] - 2.0 * g
        np.maximum(d, 0.0, out=d)
        return d
    return 1.0 - g / (np.sqrt(cn2)[:, None] * np.sqrt(qn2)[None, :])


def _tile_topk(dr, c, q, ids, k, metric):
    """Top-k by (distance, id) of each column of a masked distance tile.
    Returns (k x b distances, k x b ids); missing entries are inf / -1."""
    n, b = dr.shape
    out_d = np.full((k, b), np.inf)
    out_i = np.full((k, b), -1, dtype=np.int64)
    if n == 0 or b == 0:
        return out_d, out_i
    kk = min(n, k + 2)
    if kk < n:
        cand = np.argpartition(dr, kk - 1, axis=0)[:kk]
    else:
        cand = np.broadcast_to(np.arange(n)[:, None], (n, b))
    cd = np.take_along_axis(dr, cand, 0)
    # Columns whose k-th value is tied beyond the candidate set need all tied rows.
    risky = np.zeros(b, dtype=bool)
    if kk < n:
        kth = np.partition(cd, min(k, kk) - 1, axis=0)[min(k, kk) - 1]
        fin = np.isfinite(kth)
        thr = np.where(fin, kth + _EPS * np.maximum(1.0, np.abs(kth)), np.inf)
        cnt = (dr <= thr[None, :]).sum(axis=0)
        risky = fin & (cnt > kk)
    exact = _pair_distance(c[cand], q[None, :, :], metric)
    exact = np.where(np.isfinite(cd), exact, np.inf)
    cid = ids[cand]
    order = np.lexsort((cid, exact), axis=0)[:k]
    m = order.shape[0]
    out_d[:m] = np.take_along_axis(exact, order, 0)
    out_i[:m] = np.take_along_axis(cid, order, 0)
    for j in np.nonzero(risky)[0]:
        rows = np.nonzero(dr[:, j] <= thr[j])[0]
        ex = _pair_distance(c[rows], q[j][None, :], metric)
        o = np.lexsort((ids[rows], ex))[:k]
        out_d[:, j] = np.inf
        out_i[:, j] = -1
        out_d[: len(o), j] = ex[o]
        out_i[: len(o), j] = ids[rows][o]
    out_i[~np.isfinite(out_d)] = -1
    return out_d, out_i


def _pairs_topk(q, d, ids, k):
    """Top-k by (distance, id) of each query among pairs: the queries, k x queries
    distances and ids; missing entries are inf / -1."""
    order = np.lexsort((ids, d, q))
    order = order[np.isfinite(d[order])]
    q, d, ids = q[order], d[order], ids[order]
    own, first, col = np.unique(q, return_index=True, return_inverse=True)
    place = np.arange(len(q)) - first[col] if len(q) else col
    some = place < k
    out_d, out_i = np.full((k, len(own)), np.inf), np.full((k, len(own)), -1, dtype=np.int64)
    out_d[place[some], col[some]] = d[some]
    out_i[place[some], col[some]] = ids[some]
    return own, out_d, out_i


def _merge(best_d, best_i, new_d, new_i, k):
    d = np.vstack([best_d, new_d])
    i = np.vstack([best_i, new_i])
    key_i = np.where(i < 0, np.iinfo(np.int64).max, i)
    o = np.lexsort((key_i, d), axis=0)[:k]
    return np.take_along_axis(d, o, 0), np.take_along_axis(i, o, 0)


def _id_type(df: DataFrame, col: str) -> T.DataType:
    """Integer ids are carried as long, all others as text."""
    kind = df.select(col).schema[0].dataType
    return T.LongType() if isinstance(kind, T.IntegralType) else T.StringType()



class Block:
    """Queries of one vector length with their best cases so far."""

    def __init__(self, qids, qmat, labels: list, routes: tuple[Route, ...], metric: str, names_type, exclude_self: bool):
        self.qids, self.qmat, self.routes, self.metric = qids, qmat, routes, metric
        self.qn2 = np.einsum("ij,ij->i", qmat, qmat)
        # one product tells how near a pair is: of unit vectors, or of vectors with a term for the case's length
        self.qside = self._units(qmat, self.qn2) if metric == "cosine" else np.hstack([qmat, np.ones((len(qids), 1))])
        self.best = [(np.full((r.k, len(qids)), np.inf), np.full((r.k, len(qids)), -1, dtype=np.int64)) for r in routes]
        # filtered routes: the queries of each label
        self.of_label = [None if col is None else {v: np.asarray(i) for v, i in pd.Series(np.arange(len(qids))).groupby(
            pd.Series(col, dtype=object)).groups.items()} for col in labels]
        # Candidates are held as positions in ``names``, the ascending ids of the kept
        # candidates and the current batch: position order is id order.
        self.names = np.empty(0, dtype=names_type)
        self.column = dict(zip(qids.tolist(), range(len(qids)))) if exclude_self else {}
        self.products = 0

    def meet(self, ids: np.ndarray, mat: np.ndarray, labels: list, keys) -> None:
        """Cases of a batch; ``keys`` are their ids in the kind of query ids."""
        n2 = np.einsum("ij,ij->i", mat, mat)
        if self.metric == "cosine" and not n2.all():
            some = n2 > 0
            ids, mat, n2, keys = ids[some], mat[some], n2[some], keys[some]
            labels = [None if c is None else c[some] for c in labels]
        if not len(ids):
            return
        used = np.unique(np.concatenate([i[i >= 0] for _, i in self.best]))
        recode = np.full(len(self.names) + 1, -1, dtype=np.int64)
        self.names, place = np.unique(np.concatenate([self.names[used], ids]), return_inverse=True)
        recode[used] = place[: len(used)]
        self.best = [(d, recode[i]) for d, i in self.best]
        codes = place[len(used) :]
        own = np.array([self.column.get(k, -1) for k in keys.tolist()], np.int64) if self.column else None
        side = self._units(mat, n2) if self.metric == "cosine" else np.hstack([mat, -0.5 * n2[:, None]])
        for r, route in enumerate(self.routes):
            if not route.filtered:
                self._tiles(r, np.arange(len(ids)), np.arange(len(self.qids)), mat, side, n2, codes, own)
                continue
            for label, rows in pd.Series(np.arange(len(ids))).groupby(pd.Series(labels[r], dtype=object)).groups.items():
                if (cols := self.of_label[r].get(label)) is not None:
                    self._tiles(r, np.asarray(rows), cols, mat, side, n2, codes, own)

    @staticmethod
    def _units(mat, n2):
        """Unit vectors in single precision: half the time of a product, whose error is
        bounded (each is at most 1) and allowed for in ``_limits``."""
        return (mat / np.sqrt(n2)[:, None]).astype(np.float32)

    def _limits(self, kth, q, n2):
        """Products from which on a case may be among the best, given the k-th best
        distances so far: lower by what rounding may take."""
        slack = _EPS * np.maximum(1.0, np.abs(kth))
        if self.metric == "cosine":
            return 1.0 - kth - slack - (self.qmat.shape[1] + 16) * _SINGLE  # with those of the limit itself
        return 0.5 * (self.qn2[q] - kth - slack - _ROUNDING * (self.qn2[q] + n2.max()))

    def _tiles(self, r, rows, cols, mat, side, n2, codes, own):
        """Cases times queries, tile by tile. Only pairs that may still enter the best
        are measured and ranked; a query with many of them in a tile (its first tile,
        or many equal distances) is ranked over the whole tile."""
        best_d, best_i = self.best[r]
        k = self.routes[r].k
        upto = 0
        while upto < len(rows):
            step = CASE_TILE if upto or np.isfinite(best_d[k - 1, cols]).all() else min(FIRST_TILE, CASE_TILE)
            c = rows[upto : upto + step]
            upto += len(c)
            cm, cs, cn2 = mat[c], side[c], n2[c]
            for q0 in range(0, len(cols), QUERY_TILE):
                q = cols[q0 : q0 + QUERY_TILE]
                self.products += len(c) * len(q)
                tile = cs @ self.qside[q].T
                if own is not None:
                    at = np.searchsorted(q, own[c])  # columns ascend
                    hit = np.flatnonzero((at < len(q)) & (q[np.minimum(at, len(q) - 1)] == own[c]))
                    tile[hit, at[hit]] = np.nan  # never near
                limits = self._limits(best_d[k - 1, q], q, cn2)
                some = np.flatnonzero(~(tile.max(axis=0) < limits))  # most queries have no near case; a NaN tells nothing
                if not len(some):
                    continue
                if 8 * len(some) <= len(q):  # a few columns are taken out
                    q, tile, limits = q[some], tile[:, some], limits[some]
                near = tile >= limits.astype(tile.dtype)
                n_near = np.count_nonzero(near, axis=0)
                many = np.flatnonzero(n_near > k + FEW)
                if len(many):
                    near[:, many] = False
                    dist = _block_distance(cm, self.qmat[q[many]], cn2, self.qn2[q[many]], self.metric)
                    dist[np.isnan(tile[:, many])] = np.inf
                    self._put(r, q[many], *_tile_topk(dist, cm, self.qmat[q[many]], codes[c], k, self.metric))
                if len(many) < len(q):
                    at_c, at_q = np.divmod(np.flatnonzero(near), len(q))
                    if len(at_c):
                        exact = _pair_distance(cm[at_c], self.qmat[q[at_q]], self.metric)
                        self._put(r, *_pairs_topk(q[at_q], exact, codes[c[at_c]], k))

    def _put(self, r, q, new_d, new_i):
        best_d, best_i = self.best[r]
        best_d[:, q], best_i[:, q] = _merge(best_d[:, q], best_i[:, q], new_d, new_i, self.routes[r].k)

    def rows(self, partial: pa.Schema) -> pa.RecordBatch:
        cols = ([], [], [], [])
        for r, (d, i) in enumerate(self.best):
            rank, at = np.nonzero(np.isfinite(d) & (i >= 0))
            cols[0].append(self.qids[at])
            cols[1].append(np.full(len(at), r + 1, dtype=np.int32))
            cols[2].append(self.names[i[rank, at]])
            cols[3].append(d[rank, at])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(cols, partial)], schema=partial)


class Meeting:
    """The blocks of a task, one per vector length, and the cases that meet them."""

    def __init__(self, routes, metric, exclude_self, q_cols, c_cols, partial: pa.Schema):
        self.routes, self.metric, self.exclude_self, self.partial = routes, metric, exclude_self, partial
        self.q_at = [q_cols.index(r.query_col) if r.filtered else None for r in routes]
        self.c_at = [c_cols.index(r.case_col) if r.filtered else None for r in routes]
        case_type, self.query_type = partial.field("id").type, partial.field("query_id").type
        self.case_kind = np.int64 if pa.types.is_integer(case_type) else object
        self.same_kind = case_type == self.query_type
        self.blocks: dict[int, Block] = {}

    def add_queries(self, table) -> None:
        """Columns: id, vector, label columns."""
        ids = table.column(0).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(0).to_numpy()
        cols = [np.asarray(table.column(2 + j).to_pylist(), dtype=object) for j in range(table.num_columns - 2)]
        for rows, mat in _by_length(table.column(1)):
            if self.metric == "cosine":
                some = np.einsum("ij,ij->i", mat, mat) > 0
                rows, mat = rows[some], mat[some]
            if len(rows):
                labels = [None if j is None else cols[j][rows] for j in self.q_at]
                self.blocks[mat.shape[1]] = Block(ids[rows], mat, labels, self.routes, self.metric, self.case_kind, self.exclude_self)

    def add_cases(self, batch) -> None:
        """Columns: id, vector, label columns."""
        if not batch.num_rows or not self.blocks:
            return
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(self.case_kind)
        labels: list | None = None
        for rows, mat in _by_length(batch.column(1)):
            block = self.blocks.get(mat.shape[1])
            if block is None or not len(rows):
                continue
            if labels is None:
                labels = [None if j is None else np.asarray(batch.column(2 + j).to_pylist(), dtype=object) for j in self.c_at]
            keys = ids[rows] if self.same_kind else np.array([str(v) for v in ids[rows]], dtype=object)
            block.meet(ids[rows], mat, [None if c is None else c[rows] for c in labels], keys)

    def rows(self):
        for dim in sorted(self.blocks):
            yield self.blocks[dim].rows(self.partial)


def _broadcast_task(bc, new_meeting):
    """Cases of a partition against the broadcast queries."""

    def task(batches):
        meeting = new_meeting()
        meeting.add_queries(bc.value)
        for batch in batches:
            meeting.add_cases(batch)
        yield from meeting.rows()

    return task


def _partition_task(new_meeting, n_q: int, n_c: int):
    """Rows (is_case, then n_q query columns, then n_c case columns), queries first."""

    def task(batches):
        meeting, held = new_meeting(), []

        def begin():
            if held:
                meeting.add_queries(pa.Table.from_batches(held).combine_chunks())
                held.clear()

        for batch in batches:
            first = int(np.searchsorted(batch.column(0).to_numpy(zero_copy_only=False), True))
            if first:
                held.append(pa.RecordBatch.from_arrays(batch.columns[1 : 1 + n_q], names=batch.schema.names[1 : 1 + n_q]).slice(0, first))
            if first < batch.num_rows:
                begin()
                meeting.add_cases(pa.RecordBatch.from_arrays(batch.columns[1 + n_q :], names=batch.schema.names[1 + n_q :]).slice(first))
        yield from meeting.rows()

    return task


def _dealt(least: int, n_c: int, slots: int) -> tuple[int, int]:
    """Groups of queries (``least`` or more) and shards of ``n_c`` cases, as many pairs as
    fill all slots evenly. Every case is sent to each group, and every query starts anew
    in each shard: where slots are left, about twice as many groups as shards."""
    shards = max(1, math.ceil(n_c / SHARD_ROWS), min(slots // least, n_c // CASE_TILE, math.isqrt(slots // 2)))
    rounds = math.ceil(least * shards / slots)
    return max(least, rounds * slots // shards), shards


def vector_ok(col: str, dim: int | None = None, metric: str = "sql2"):
    """Column predicate: vector present, of length ``dim`` (when given), all elements
    finite and, for cosine, a non-zero norm."""
    c = F.col(col)
    cond = c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dim is not None:
        cond = cond & (F.size(c) == F.lit(dim))
    if metric == "cosine":
        cond = cond & (F.aggregate(c, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")) > 0)
    return cond


def _collect_block(df: DataFrame) -> pa.Table:
    return df.toArrow().combine_chunks()


def nearest(
    cases: DataFrame,
    queries: DataFrame,
    routes: tuple[Route, ...] | list[Route] = (Route(3),),
    *,
    case_id: str = "id",
    case_vec: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    metric: str = "sql2",
    exclude_self: bool = False,
    dim: int | None = None,
    max_block_rows: int = MAX_BLOCK_ROWS,
    max_block_bytes: int = MAX_BLOCK_BYTES,
    broadcast_rows: int = MAX_BROADCAST_ROWS,
    with_bound: bool = False,
) -> DataFrame | tuple[DataFrame, int]:
    """Top-k cases per (query, route), long form
    ``(query_id, route, rank, id, distance)``; route numbers follow ``routes``
    order starting at 1. Queries meet the cases of their own vector length (only
    those of length ``dim``, if given). Query ids must be unique; queries whose vector
    is null, empty or not finite (or zero, for cosine) get no rows, and neither do
    those for which no case is left: ``retrieve.query_status`` names them. Runs one
    aggregate of the query table (rows and components) and a count of the cases;
    a query table of at most ``broadcast_rows`` rows (and 32 MB) is broadcast,
    any other meets the cases in partitions of (query group, case shard).
    ``with_bound`` also returns the proven maximum row count of the result
    (queries x sum of k) for sizing a later broadcast, or None where text ids
    leave the size in bytes open."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    routes = tuple(routes)
    spark: SparkSession = cases.sparkSession
    c_cols = sorted({r.case_col for r in routes if r.filtered})
    q_cols = sorted({r.query_col for r in routes if r.filtered})
    id_type, qid_type = _id_type(cases, case_id), _id_type(queries, query_id)
    schema = T.StructType([
        T.StructField("query_id", qid_type), T.StructField("route", T.IntegerType()),
        T.StructField("id", id_type), T.StructField("distance", T.DoubleType()),
    ])
    qsel = queries.select(
        F.col(query_id).cast(qid_type).alias("qid"),
        F.col(query_vec).alias("qvec"),
        *[F.col(c).cast("string").alias(f"ql_{c}") for c in q_cols],
    ).where(vector_ok("qvec", dim, metric) & F.col("qid").isNotNull())
    n_q, components = qsel.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("qvec")), F.lit(0))).first()
    csel = cases.select(
        F.col(case_id).cast(id_type).alias("cid"),
        F.col(case_vec).alias("cvec"),
        *[F.col(c).cast("string").alias(f"cl_{c}") for c in c_cols],
    ).where(F.col("cid").isNotNull() & (F.size("cvec") > 0))
    arrow = to_arrow_schema(schema)

    def new_meeting():
        return Meeting(routes, metric, exclude_self, q_cols, c_cols, arrow)

    if n_q <= min(broadcast_rows, max_block_rows) and 8 * components <= min(MAX_BROADCAST_BYTES, max_block_bytes):
        # a case table in fewer partitions than slots (one row group) is dealt out
        bc = spark.sparkContext.broadcast(_collect_block(qsel))
        partial = spread(csel).mapInArrow(_broadcast_task(bc, new_meeting), schema)
    else:
        n_c, slots = cases.count(), spark.sparkContext.defaultParallelism
        least = max(1, math.ceil(n_q / max_block_rows), math.ceil(8 * components / max_block_bytes))
        groups, shards = _dealt(least, n_c, slots)
        kind = "array<float>" if {d.dtypes[1][1] for d in (qsel, csel)} == {"array<float>"} else "array<double>"
        own = F.pmod(F.xxhash64("qid", F.lit(1)), F.lit(groups))
        q = qsel.withColumn("qvec", F.col("qvec").cast(kind)).withColumn("is_case", F.lit(False)).withColumn(
            "to", F.explode(F.sequence(own * shards, own * shards + shards - 1)))
        mine = F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(shards))
        c = csel.withColumn("cvec", F.col("cvec").cast(kind)).withColumn("is_case", F.lit(True)).withColumn(
            "to", F.explode(F.sequence(mine, mine + (groups - 1) * shards, F.lit(shards).cast("long"))))
        columns = ["is_case", *qsel.columns, *csel.columns]
        both = q.unionByName(c, allowMissingColumns=True).repartitionById(groups * shards, F.col("to").cast("int"))
        partial = both.sortWithinPartitions("is_case").select(*columns).mapInArrow(
            _partition_task(new_meeting, len(qsel.columns), len(csel.columns)), schema)
    w = Window.partitionBy("query_id", "route").orderBy("distance", "id")
    # a literal bound lets Spark plan WindowGroupLimit (partial top-k before
    # the shuffle); routes with a smaller k are trimmed after
    ranked = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(r.k for r in routes))
    if len({r.k for r in routes}) > 1:
        ks = F.array(*[F.lit(r.k) for r in routes])
        ranked = ranked.where(F.col("rank") <= F.element_at(ks, F.col("route")))
    out = ranked.select("query_id", "route", F.col("rank").cast("long").alias("rank"), "id", "distance")
    fixed = isinstance(id_type, T.LongType) and isinstance(qid_type, T.LongType)
    return (out, n_q * sum(r.k for r in routes) if fixed else None) if with_bound else out


# Largest hit list that is broadcast: rows of five 8-byte columns (about 64 MB).
MAX_BROADCAST_HITS = 1_000_000


def broadcastable(bound: int | None) -> bool:
    """True for a hit list whose row bound is known and small."""
    return bound is not None and bound <= MAX_BROADCAST_HITS


def attach(
    hits: DataFrame, cases: DataFrame, case_id: str = "id", cols: list[str] | None = None,
    max_hits: int | None = None,
) -> DataFrame:
    """Join case payload columns back onto the hit list by id. Hit ids come
    from the case table, so an inner join loses nothing; with a proven bound
    the hits are broadcast and the case table is only scanned (its payload
    columns never shuffle). Without a bound the planner / AQE decides. Case ids
    must be unique: a hit on an id that several case rows carry fails the job."""
    payload = cases.select(F.col(case_id).cast(hits.schema["id"].dataType).alias("id"), *[F.col(c) for c in (cols or [])])
    if broadcastable(max_hits):
        joined = payload.join(F.broadcast(hits), "id", "inner").select(*hits.columns, *(cols or []))
    else:
        joined = hits.join(payload, "id", "left")
    same = [c for c in ("query_id", "route", "rank", "id") if c in hits.columns]
    error = F.raise_error(F.concat(F.lit("several cases with the id "), F.col("id").cast("string"))).cast("boolean")
    counted = joined.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*same)))
    return counted.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(error)).drop("_n")


# Functions of this module run inside Python workers (mapInArrow/mapInPandas);
# ship their code with the closures so executors need no installed copy.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
