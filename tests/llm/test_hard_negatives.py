"""Hard negatives against brute force; ranges of the tree; odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from precedent.llm import hard_negatives
from precedent.llm.hard_negatives import Tree, mine_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, id string"


def brute(rows, k=5, low=80, high=100):
    ok = [(i, lab, np.floor(256 * np.array(v, np.float64))) for i, v, lab in rows if i is not None and lab is not None and v
          and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, _, v in ok), default=0)
    x = np.array([np.pad(v, (0, dim - len(v))) for _, _, v in ok]).astype(np.int64).reshape(len(ok), dim)
    out = []
    for a, (i, lab, _) in enumerate(ok):
        if i % 100:
            continue
        s = (x @ x[a]).tolist()
        order = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-s[b], ok[b][0]))
        for p in [b for b in order if ok[b][1] == lab][:k]:
            hit = [b for b in order if ok[b][1] != lab and low * s[p] <= 100 * s[b] <= high * s[p]][:k]
            out += [(i, ok[p][0], r + 1, ok[b][0], s[p], s[b]) for r, b in enumerate(hit)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, 1, "x") for i, v, lab in rows], SCHEMA)


def vectors(rng, n, dim=12):
    centre = rng.normal(size=(6, dim))
    out = []
    for i in range(n):
        v = centre[rng.integers(6)] * 0.3 + rng.normal(size=dim) * 0.1
        out.append((i * 5, v.astype(np.float32).tolist(), int(rng.integers(4))))
    return out


@pytest.mark.parametrize("opts", [{}, {"piece": 16, "block": 3, "sample": 40, "leaf": 5}])
def test_result_equals_brute_force(spark, opts):
    rng = np.random.default_rng(7)
    rows = vectors(rng, 400)
    same = rows[3][1]  # a third are copies of one vector
    rows = [(i, same if i % 3 == 0 else v, lab) for i, v, lab in rows]
    got = mine_negatives(table(spark, rows).repartition(3), F.col("vec_id") % 100 == 0, **opts)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == brute(rows) and len(got) > 100


def test_leaves_are_skipped_and_none_that_counts(spark):
    rng = np.random.default_rng(1)
    x = np.floor(256 * (np.repeat(rng.normal(size=(40, 8)), 50, axis=0) + 0.02 * rng.normal(size=(2000, 8))))
    top = int((x * x).sum(axis=1).max())
    tree = Tree(x[::4], 8, top, 8)
    leaf = tree.place(x)
    tree.watch(x, leaf)
    s = x[:100] @ x.T
    for low, high in ((0.95, 1.0), (0.5, 0.6)):
        own = (x[:100] ** 2).sum(axis=1)[:, None]
        kept = tree.leaves(x[:100], low * own, high * own)
        hit = (s >= low * own) & (s <= high * own)
        need = np.zeros_like(kept)
        for i in range(100):
            need[i, leaf[hit[i]]] = True
        used = np.bincount(leaf, minlength=64) > 0
        assert (kept >= need).all() and kept[:, used].mean() < 0.6


def test_odd_rows(spark):
    empty = mine_negatives(table(spark, []), F.col("vec_id") % 100 == 0)
    assert empty.count() == 0 and len(empty.columns) == 6
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0, 0], 1), (100, [0, 0, 0], 2), (1, [1, 0], 1), (2, [0.9, 0.1, 0], 2), (3, [0.85], 3), (4, [nan, 0, 0], 1), (5, [inf, 0, 0], 2),
            (6, None, 1), (7, [], 1), (8, [1, None, 0], 2), (9, [1, 0, 0], None), (None, [1, 0, 0], 1), (200, [-1, 0, 0], 1), (10, [0, 0, 0], 2),
            (11, [1e9, 0, 0], 2), (300, [0.5, 0.5, 0.5], 9)]
    got = sorted(tuple(r) for r in mine_negatives(table(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == brute([r for r in rows if r[0] != 11]) and {g[0] for g in got} == {0, 100}
    twice = [(0, [1, 0], 1), (0, [1, 0], 1), (1, [0.9, 0.5], 2), (1, [0.9, 0.5], 2)]
    got = [tuple(r) for r in mine_negatives(table(spark, twice), F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 0, 1, 1, 65536, 58880)] * 2 + [(0, 0, 2, 1, 65536, 58880)] * 2


def test_components_of_two_and_four_bytes_in_one_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [y * (2000 if i % 3 == 0 else 1) for y in v], lab) for i, v, lab in vectors(rng, 200)]
    rows += [(2000, [-128.0, 127.99] * 6, 1), (2005, [128.0] * 12, 1), (2010, [-128.01] * 12, 2), (2100, [128.0] * 11 + [127.9], 2)]
    got = sorted(tuple(r) for r in mine_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, piece=8, block=2, sample=40, leaf=5).collect())
    assert got == brute([(i, np.array(v, np.float32).tolist(), lab) for i, v, lab in rows]) and len(got) > 20


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Only the list of leaves (at most FANOUT^2 rows) passes through the driver, however
    small the files look to Spark."""
    rows = vectors(np.random.default_rng(5), 300)
    plans, save, before = [], hard_negatives.save, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(hard_negatives, "save", lambda df, name: (plans.append((name, plan(df))), save(df, name))[1])
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
        out = mine_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)
        plans.append(("result", plan(out)))
        got = sorted(tuple(r) for r in out.collect())
        plans.append(("result as run", plan(out)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(rows)
    assert [n for n, p in plans if "SortMergeJoin" in p] == ["own-leaf", "found", "windows", "own-leaf", "found", "result", "result as run"]
    assert {n for n, p in plans if "BroadcastExchange" in p} == {"pieces"}
