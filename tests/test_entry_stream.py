import tempfile

from pyspark.sql import functions as F

from tests.conftest import SMOKE


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_runs_on_smoke_data(spark):
    import __spark_entry__ as E

    for name, fn in E.queries().items():
        df = fn(spark, SMOKE)
        assert df.columns, name
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    from precedent.plans.tables import cases, read
    from precedent.streaming.requests import answer_requests, run_available

    ev = read(spark, SMOKE, "events").select("event_id", "user_id")
    src_dir = tempfile.mkdtemp(prefix="precedent-stream-src-")
    ev.write.mode("overwrite").parquet(src_dir)
    cs = cases(spark, SMOKE)
    vectors = read(spark, SMOKE, "embeddings").select(F.col("vec_id").alias("query_key"), "embedding")

    def answer(batch):
        return answer_requests(batch.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("query_key")),
                               cs, vectors)

    sink, ckpt = tempfile.mkdtemp(prefix="sink-"), tempfile.mkdtemp(prefix="ckpt-")
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src_dir)
    out1 = run_available(spark, source, answer, sink, ckpt).drop("batch_id")
    batch = answer(ev)
    assert out1.exceptAll(batch).count() == 0 and batch.exceptAll(out1).count() == 0
    n1 = out1.count()
    out2 = run_available(spark, source, answer, sink, ckpt).drop("batch_id")  # restart: nothing new
    assert out2.count() == n1


def test_requests_isolate_bad_rows_and_gate(spark):
    from precedent.streaming.requests import answer_requests

    cases = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "id long, embedding array<float>")
    vectors = spark.createDataFrame([(10, [1.0, 0.05]), (11, [0.0, 0.0]), (12, [-1.0, -0.2])],
                                    "query_key long, embedding array<float>")
    reqs = spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, 99)], "request_id long, query_key long")
    out = answer_requests(reqs, cases, vectors, k=2, metric="cosine", threshold=0.65, exclude_self=False)
    rows = {}
    for r in out.collect():
        rows.setdefault(r.request_id, []).append(r)
    assert [r.status for r in rows[100]] == ["ok", "ok"] and sorted(r.rank for r in rows[100]) == [1, 2]
    assert [(r.status, r.rank) for r in rows[101]] == [("error", None)]  # zero vector
    assert [(r.status, r.rank) for r in rows[102]] == [("refused", None)]  # best cosine distance > 0.65
    assert [(r.status, r.message) for r in rows[103]] == [("error", "no usable query vector")]


def test_requests_without_text_are_dead_letters(spark):
    from precedent.streaming.requests import answer_requests

    cases = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    vectors = spark.createDataFrame([(10, [1.0, 0.05])], "query_key long, embedding array<float>")
    reqs = spark.createDataFrame([(1, 10, "ask"), (2, 10, " \n\t"), (3, 10, None), (4, 99, ""), (5, 99, "ask")],
                                 "request_id long, query_key long, status string")
    out = answer_requests(reqs, cases, vectors, k=1, exclude_self=False, text_col="status")
    assert sorted((r.request_id, r.status, r.id, r.message) for r in out.collect()) == [
        (1, "ok", 1, None), (2, "rejected", None, "blank"), (3, "rejected", None, "missing"), (4, "rejected", None, "blank"),
        (5, "error", None, "no usable query vector")]


def _report_inputs(spark):
    cases = spark.createDataFrame(
        [(1, [1.0, 0.0], "A", "f", "x", None, "Industry: f. Reasons: r1. Archetype: x."),
         (2, [0.9, 0.1], "B", "g", "x", "$2M", "Industry: g. Reasons: r2. Archetype: x."),
         (3, [0.0, 1.0], "C", "f", "y", "$3M", "no markers")],
        "id long, embedding array<float>, company_name string, industry string, archetype string, funding_amount string, document string")
    queries = spark.createDataFrame(
        [(10, [1.0, 0.05], True, "g", "y"), (11, [0.0, 0.0], True, "f", "x"), (12, [-1.0, -0.2], False, None, None)],
        "query_id long, embedding array<float>, classified boolean, q_industry string, q_archetype string")
    requests = spark.createDataFrame(
        [(1, 10, " ask "), (2, 10, "\t\n"), (3, None, None), (4, 11, "zero"), (5, 12, "far"), (6, 99, "gone"), (7, 10, "again"), (8, None, "no key")],
        "request_id long, query_key long, request string")
    return requests, cases, queries


def test_report_of_every_request(spark):
    from precedent.streaming.requests import REPORT_COLUMNS, report_requests

    requests, cases, queries = _report_inputs(spark)
    out = report_requests(requests, cases, queries, exclude_self=False)
    assert out.columns == REPORT_COLUMNS
    rows = {r.request_id: r for r in out.collect()}
    assert {k: (r.status, r.message) for k, r in rows.items() if k not in (5,)} == {
        1: ("ok", None), 2: ("rejected", "blank"), 3: ("rejected", "missing"), 4: ("error", "no usable query vector"),
        6: ("error", "no usable query vector"), 7: ("ok", None), 8: ("error", "no usable query vector")}
    assert rows[5].status == "refused" and rows[5].message and rows[5].matched_cases is None and rows[5].target_id is None
    one = rows[1]
    assert (one.target_id, one.outcome, one.threat) == ("A", "Raised Unknown, then failed: r1", "CRITICAL")
    # routes: industry g -> B, archetype y -> C, nearest -> A; ordered by distance
    assert [(m.company_name, m.failure_reasons) for m in one.matched_cases] == [("A", "r1"), ("B", "r2"), ("C", "no markers")]
    assert "\nask\n" in one.user_message and "\nagain\n" in rows[7].user_message
    every = report_requests(requests, cases, queries, exclude_self=False, threshold=None)
    assert every.where("request_id = 5").first().status == "ok"


def test_report_stream_equals_batch_over_several_batches(spark):
    from precedent.streaming.requests import read_requests, report_requests, run_available

    requests, cases, queries = _report_inputs(spark)
    src = tempfile.mkdtemp(prefix="report-src-")
    requests.repartition(4).write.mode("overwrite").parquet(src)

    def answer(batch):
        return report_requests(batch, cases, queries, exclude_self=False)

    sink, ckpt = tempfile.mkdtemp(prefix="sink-"), tempfile.mkdtemp(prefix="ckpt-")
    out = run_available(spark, read_requests(spark, requests.schema, src, max_bytes=1), answer, sink, ckpt, held=(cases,))
    assert out.select("batch_id").distinct().count() > 1 and not cases.is_cached
    got, want = sorted(map(str, out.drop("batch_id").collect())), sorted(map(str, answer(requests).collect()))
    assert got == want


def _sources(spark, root):
    """A folder of tables whose conversations and events come in several files."""
    from precedent.plans.tables import read

    for name in ("conversations", "events"):
        read(spark, SMOKE, name).repartition(3).write.parquet(f"{root}/{name}.parquet")
    read(spark, SMOKE, "embeddings").where("vec_id < 60").repartition(2).write.parquet(f"{root}/embeddings.parquet")
    return root


def test_streams_read_tables_of_many_files(spark, tmp_path):
    import __spark_entry__ as E
    from precedent.plans.tables import read

    root, found = _sources(spark, str(tmp_path)), E.queries()
    turns = read(spark, root, "conversations").count()
    blanks = read(spark, root, "conversations").where("turn = 0").count()
    assert found["stream_dead_letters"](spark, root).select("request_id").distinct().count() == turns
    assert found["stream_report"](spark, root).count() == turns + blanks
    assert found["stream_retrieve"](spark, root).select("request_id").distinct().count() == read(spark, root, "events").count()


def test_stream_of_an_empty_folder_is_an_empty_answer(spark, tmp_path):
    from precedent.streaming.requests import OUTPUT_COLUMNS, answer_requests, read_requests, run_available

    (tmp_path / "in").mkdir()
    cases = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    vectors = spark.createDataFrame([(10, [1.0, 0.05])], "query_key long, embedding array<float>")
    source = read_requests(spark, "request_id long, query_key long", str(tmp_path / "in"))
    out = run_available(spark, source, lambda b: answer_requests(b, cases, vectors), str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    assert out.select(*OUTPUT_COLUMNS).count() == 0
