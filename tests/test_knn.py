import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from precedent.operators import knn, retrieve as R


def _tables(spark, n=60, q=15, dim=8, seed=7):
    rng = np.random.default_rng(seed)
    cv = rng.normal(size=(n, dim)).astype(np.float32)
    cv[5] = cv[4]  # exact tie between ids 4 and 5
    labels = [f"L{i % 4}" for i in range(n)]
    rows = [(i, [float(x) for x in cv[i]], labels[i], f"co{i % 9}") for i in range(n)]
    rows.append((1000, None, "L0", "bad"))  # null vector
    rows.append((1001, [1.0, 2.0], "L0", "bad"))  # wrong length
    cases = spark.createDataFrame(rows, "id long, embedding array<float>, industry string, company_name string")
    qv = rng.normal(size=(q, dim)).astype(np.float32)
    qv[0] = cv[4]
    qrows = [(100 + j, [float(x) for x in qv[j]], f"L{j % 5}") for j in range(q)]
    queries = spark.createDataFrame(qrows, "query_id long, embedding array<float>, q_industry string")
    return cv, labels, qv, cases, queries


def _brute(cv, qv, k, labels=None, qlab=None, metric="sql2"):
    out = {}
    for j in range(len(qv)):
        res = []
        for i in range(len(cv)):
            if labels is not None and labels[i] != qlab[j]:
                continue
            c, q = cv[i].astype(np.float64), qv[j].astype(np.float64)
            d = float(((c - q) ** 2).sum()) if metric == "sql2" else 1 - float(c @ q) / (np.linalg.norm(c) * np.linalg.norm(q))
            res.append((d, i))
        res.sort()
        out[100 + j] = [(i, round(d, 9)) for d, i in res[:k]]
    return out


def _got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.distance, 9)))
    return out


@pytest.mark.parametrize("metric", ["sql2", "cosine"])
def test_topk_matches_brute_force(spark, metric):
    cv, _, qv, cases, queries = _tables(spark)
    got = _got(knn.nearest(cases, queries, [knn.Route(3)], metric=metric))
    assert got == _brute(cv, qv, 3, metric=metric)


def test_tie_broken_by_id(spark):
    cv, _, qv, cases, queries = _tables(spark)
    got = _got(knn.nearest(cases, queries, [knn.Route(2)]))
    assert got[100][0] == (4, 0.0) and got[100][1] == (5, 0.0)


def test_filtered_route_matches_brute_force(spark):
    cv, labels, qv, cases, queries = _tables(spark)
    qlab = [f"L{j % 5}" for j in range(len(qv))]
    got = _got(knn.nearest(cases, queries, [knn.Route(1, "industry", "q_industry")]))
    exp = {k: v for k, v in _brute(cv, qv, 1, labels, qlab).items() if v}
    assert got == exp  # label L4 matches no case: those queries have no row


def test_blocked_query_side_equals_single_block(spark):
    _, _, _, cases, queries = _tables(spark)
    a = _got(knn.nearest(cases, queries, [knn.Route(3)]))
    b = _got(knn.nearest(cases, queries, [knn.Route(3)], max_block_rows=4))
    assert a == b


def test_topk_prefix_property(spark):
    _, _, _, cases, queries = _tables(spark)
    k2, k3 = _got(knn.nearest(cases, queries, [knn.Route(2)])), _got(knn.nearest(cases, queries, [knn.Route(3)]))
    assert all(k3[q][:2] == k2[q] for q in k2)


def test_exclude_self_and_zero_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 0.0])]
    cases = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = cases.withColumnRenamed("id", "query_id")
    got = _got(knn.nearest(cases, queries, [knn.Route(1)], metric="cosine", exclude_self=True))
    assert got[0][0][0] == 1 and got[1][0][0] == 0
    assert 2 not in got  # zero query vector has no cosine neighbour


def test_plan_has_no_pair_explosion(spark):
    _, _, _, cases, queries = _tables(spark)
    plan = knn.nearest(cases, queries, [knn.Route(3)])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_multiroute_dedupe_and_fallback(spark):
    cv, labels, qv, cases, queries = _tables(spark)
    q = queries.withColumn("classified", F.col("query_id") % 3 != 0).withColumn("q_archetype", F.lit("none"))
    c = cases.withColumn("archetype", F.lit("x"))
    res = R.multiroute(c, q)
    rows = res.collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r.query_id, []).append(r)
    for qid, rs in by_q.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1))
        assert all(a.distance <= b.distance for a, b in zip(rs, rs[1:]))
        if qid % 3 == 0:
            assert len(rs) == 3 and all(r.fallback for r in rs)
        else:
            names = [r.company_name for r in rs]
            assert len(names) == len(set(names)) and 1 <= len(rs) <= 3
    # the global top-1 company is always among a classified query's matches
    top = {r.query_id: r.company_name for r in R.topk(c, q, k=1, payload=["company_name"]).collect()}
    for qid, rs in by_q.items():
        assert top[qid] in {r.company_name for r in rs}


def test_gate_threshold_equal_passes(spark):
    res = spark.createDataFrame([(1, 1, 0.65), (2, 1, 0.6500001)], "query_id long, rank long, distance double")
    st = {r.query_id: r.status for r in R.gate(res, 0.65).collect()}
    assert st == {1: "ok", 2: "refused"}


@pytest.mark.parametrize("metric", ["sql2", "cosine"])
def test_distances_equal_per_pair_expression(spark, metric):
    from precedent.functions.vectors import cosine_distance, squared_l2

    _, _, _, cases, queries = _tables(spark)
    hits = knn.nearest(cases, queries, [knn.Route(3)], metric=metric)
    pair = squared_l2("cv", "qv") if metric == "sql2" else cosine_distance("cv", "qv")
    check = (
        hits.join(cases.select("id", F.col("embedding").alias("cv")), "id")
        .join(queries.select("query_id", F.col("embedding").alias("qv")), "query_id")
        .select((F.abs(F.col("distance") - pair)).alias("err"))
    )
    assert check.agg(F.max("err")).first()[0] < 1e-12


def test_a_length_without_cases_has_no_rows(spark):
    cases = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(10, [1.0, 2.0]), (11, [0.9, 0.1, 0.0]), (12, [0.1, 0.9, 0.0])],
                                    "query_id long, embedding array<float>")
    got = _got(knn.nearest(cases, queries, [knn.Route(1)]))
    assert set(got) == {11, 12} and got[11][0][0] == 1 and got[12][0][0] == 2


def test_many_case_partitions(spark):
    cv, _, qv, cases, queries = _tables(spark)
    hits = knn.nearest(cases.repartition(40), queries, [knn.Route(3)])
    assert _got(hits) == _brute(cv, qv, 3)
    assert "Coalesce " not in hits._jdf.queryExecution().executedPlan().toString()


def test_every_length_is_answered_whatever_the_blocks(spark):
    cv, _, qv, cases, queries = _tables(spark, q=40)
    short = spark.createDataFrame([(i, [1.0, 2.5], "L0") for i in range(15)], queries.schema)
    mixed = short.unionByName(queries)
    whole = _got(knn.nearest(cases, mixed, [knn.Route(2)]))
    assert {q: h for q, h in whole.items() if q >= 100} == _brute(cv, qv, 2)
    assert {q: h for q, h in whole.items() if q < 100} == {i: [(1001, 0.25)] for i in range(15)}
    for n in (1, 7, 16):
        assert _got(knn.nearest(cases, mixed, [knn.Route(2)], max_block_rows=n)) == whole
    assert _got(knn.nearest(cases, mixed, [knn.Route(2)], max_block_bytes=8 * 8 * 5)) == whole
    only = _got(knn.nearest(cases, mixed, [knn.Route(2)], dim=8, broadcast_rows=0))
    assert only == {q: h for q, h in whole.items() if q >= 100}


@pytest.mark.parametrize("metric", ["sql2", "cosine"])
def test_no_query_row_reaches_the_driver(spark, monkeypatch, metric):
    cv, labels, qv, cases, queries = _tables(spark, n=500, q=60)
    routes = [knn.Route(2), knn.Route(1, "industry", "q_industry")]
    small = sorted(map(tuple, knn.nearest(cases, queries, routes, metric=metric).collect()))
    monkeypatch.setattr(knn, "_collect_block", None)
    monkeypatch.setattr(knn, "CASE_TILE", 64)  # so that the cases are dealt to several shards
    for n in (7, 16, 1000):
        hits = knn.nearest(cases.repartition(3), queries, routes, metric=metric, max_block_rows=n, broadcast_rows=0)
        rows = sorted(map(tuple, hits.collect()))
        assert [r[:4] for r in rows] == [r[:4] for r in small] and np.allclose([r[4] for r in rows], [r[4] for r in small])


def test_a_filtered_route_multiplies_one_label_at_a_time():
    rng = np.random.default_rng(3)
    partial = pa.schema([("query_id", pa.int64()), ("route", pa.int32()), ("id", pa.int64()), ("distance", pa.float64())])
    column = lambda n, labels: [pa.array(range(n)), pa.array(rng.normal(size=(n, 6)).tolist(), pa.list_(pa.float32())), pa.array(labels)]
    q_labels, c_labels = ["a"] * 30 + ["b"] * 5 + [None] * 10, ["a"] * 20 + ["b"] * 60 + ["c"] * 500 + [None] * 40
    q, c = column(45, q_labels), column(620, c_labels)
    meeting = knn.Meeting((knn.Route(1, "l", "l"),), "sql2", False, ["l"], ["l"], partial)
    meeting.add_queries(pa.RecordBatch.from_arrays(q, ["i", "v", "l"]))
    meeting.add_cases(pa.RecordBatch.from_arrays(c, ["i", "v", "l"]))
    assert meeting.blocks[6].products == 30 * 20 + 5 * 60
    got = {r["query_id"]: r["id"] for b in meeting.rows() for r in b.to_pylist()}
    x, y = (np.array(t[1].to_pylist(), np.float64) for t in (q, c))
    same = np.array([[a is not None and a == b for b in c_labels] for a in q_labels])
    d = np.where(same, ((x[:, None] - y[None]) ** 2).sum(axis=2), np.inf)
    assert got == {i: int(d[i].argmin()) for i in range(35)}


def test_status_of_every_query(spark):
    cases = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 0.0]), (3, [0.0, 0.0])], "id long, embedding array<float>")
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1.0, 0.5]), (11, None), (12, []), (13, [nan, 1.0]), (14, [inf, 1.0]), (15, [1.0]), (16, [0.0, 0.0]), (17, [None, 1.0])]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    for n in (0, 4096):
        hits = knn.nearest(cases, queries, [knn.Route(2)], metric="cosine", broadcast_rows=n)
        got = {r.query_id: (r.status, r.reason) for r in R.query_status(queries, hits, metric="cosine").collect()}
        assert got == {10: ("ok", None), 11: ("error", "null_vector"), 12: ("error", "wrong_length"), 13: ("error", "null_element"),
                       14: ("error", "not_finite"), 15: ("error", "no_case"), 16: ("error", "zero_vector"), 17: ("error", "null_element")}
        assert [r.id for r in hits.collect()] == [1]


def test_a_repeated_case_id_fails_where_payload_is_joined(spark):
    cases = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [0.9, 0.0], "b"), (2, [5.0, 5.0], "c"), (2, [9.0, 9.0], "d")],
                                  "id long, embedding array<float>, company_name string")
    queries = spark.createDataFrame([(10, [1.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="several cases with the id 1"):
        R.topk(cases, queries, k=2, payload=["company_name"]).collect()


@pytest.mark.parametrize("block", [4, 16384])
def test_text_ids(spark, block):
    cv, _, qv, cases, queries = _tables(spark)
    named = cases.withColumn("id", F.concat(F.lit("case_"), F.lpad("id", 5, "0")))
    asked = queries.withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    got = _got(knn.nearest(named.repartition(3), asked, [knn.Route(3)], max_block_rows=block))
    expected = {f"q{q}": [(f"case_{i:05d}", d) for i, d in hits] for q, hits in _brute(cv, qv, 3).items()}
    assert got == expected
    own = named.withColumnRenamed("id", "query_id").where("company_name != 'bad'")
    nearest = knn.nearest(named, own, [knn.Route(1)], exclude_self=True, max_block_rows=block)
    assert nearest.where("id = query_id").count() == 0 and nearest.count() == len(cv)
    full = R.topk(named, asked, payload=["company_name"])
    assert full.where("company_name is null").count() == 0 and full.count() == 3 * len(qv)


def _ranked(cases, queries, k, metric):
    """Plain top-k of (id, vector) pairs by (distance, id)."""
    out = {}
    for qid, q in queries:
        d = sorted((float(knn._pair_distance(np.array(c, float), np.array(q, float), metric)), i) for i, c in cases if i != qid)
        out[qid] = d[:k]
    return out


def test_only_near_pairs_are_measured_and_none_is_lost(monkeypatch):
    rng = np.random.default_rng(5)
    cases = [(i, v) for i, v in enumerate(np.round(rng.normal(size=(600, 5)), 1).tolist())]
    cases += [(1000 + i, cases[3][1]) for i in range(80)]  # one vector many times: ties across tiles
    cases = sorted(cases, key=lambda c: -sum(x * x for x in c[1]))
    queries = [c for c in cases if c[0] % 7 == 0 or c[0] in (3, 1003)]
    ids, mat = np.array([i for i, _ in cases]), np.array([v for _, v in cases])
    qids, qmat = np.array([i for i, _ in queries]), np.array([v for _, v in queries])
    monkeypatch.setattr(knn, "CASE_TILE", 64)
    monkeypatch.setattr(knn, "QUERY_TILE", 16)
    whole, tile_topk = [], knn._tile_topk
    monkeypatch.setattr(knn, "_tile_topk", lambda d, *a: whole.append(d.size) or tile_topk(d, *a))
    for metric in knn.METRICS:
        whole.clear()
        block = knn.Block(qids, qmat, [None], (knn.Route(3),), metric, np.int64, True)
        for at in range(0, len(ids), 100):
            block.meet(ids[at : at + 100], mat[at : at + 100], [None], ids[at : at + 100])
        d, i = block.best[0]
        want = _ranked(cases, queries, 3, metric)
        for j, q in enumerate(qids.tolist()):
            assert [(round(x, 12), int(n)) for x, n in zip(d[:, j], block.names[i[:, j]])] == [(round(x, 12), n) for x, n in want[q]]
        assert sum(whole) < block.products / 2  # most tiles are not ranked whole


def test_cosine_beyond_single_precision():
    rng = np.random.default_rng(8)
    mat = rng.normal(size=(12, 1, 24)) + 1e-6 * rng.normal(size=(12, 50, 24))  # fifty cases that no float32 tells apart
    mat = mat.reshape(-1, 24) * 10.0 ** rng.integers(-3, 4, size=(600, 1))
    ids = rng.permutation(600)
    block = knn.Block(ids, mat, [None], (knn.Route(2),), "cosine", np.int64, True)
    for at in range(0, 600, 150):
        block.meet(ids[at : at + 150], mat[at : at + 150], [None], ids[at : at + 150])
    assert block.qside.dtype == np.float32
    want = _ranked(list(zip(ids.tolist(), mat.tolist())), list(zip(ids.tolist(), mat.tolist())), 2, "cosine")
    d, i = block.best[0]
    for j, q in enumerate(ids.tolist()):
        assert np.allclose(d[:, j], [x for x, _ in want[q]], rtol=0, atol=1e-15)
        assert block.names[i[:, j]].tolist() == [n for _, n in want[q]]


def test_groups_and_shards_fill_the_slots():
    for least, n_c, slots in ((1, 10_000, 8), (3, 153_846, 8), (5, 300_000, 12), (10, 600_000, 12), (37, 600_000, 12), (13, 50_000, 12)):
        groups, shards = knn._dealt(least, n_c, slots)
        rounds = -(-groups * shards // slots)
        assert groups >= least and groups * shards > 0.9 * rounds * slots
        assert rounds == -(-least // slots)
    assert knn._dealt(20, 100_000_000, 12)[1] == 25  # shards stay within their rows
