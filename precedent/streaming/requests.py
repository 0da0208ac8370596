"""The request stream: every arriving request is validated, retrieved, gated
and reported by the same DataFrame functions as the batch path.

Ranking windows are not allowed on a streaming DataFrame, so the work runs in
``foreachBatch``: each micro-batch is a bounded request table. Within a batch
the distinct query vectors are searched once (many requests may share one)
and the answers joined back to the requests. Output goes to
``<sink>/batch_id=<n>`` with overwrite, so a replayed batch (after a failure
or restart from the checkpoint) replaces its own rows and adds none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from precedent.functions.vectors import vector_status
from precedent.operators import report as P
from precedent.operators import retrieve as R
from precedent.operators.knn import Route, broadcastable, nearest
from precedent.operators.quality import validate_requests

OUTPUT_COLUMNS = ["request_id", "status", "rank", "id", "distance", "message"]


def answer_requests(
    requests: DataFrame,
    cases: DataFrame,
    vectors: DataFrame,
    *,
    k: int = 3,
    metric: str = "cosine",
    threshold: float = R.GATE_THRESHOLD,
    exclude_self: bool = True,
    text_col: str | None = None,
) -> DataFrame:
    """Batch answer for a table of requests ``(request_id, query_key)`` whose
    query vectors are in ``vectors (query_key, embedding)``.

    Rows: passed requests get their top-k matches (status 'ok'); refused ones
    one row with the refusal message; requests without a usable vector one
    'error' row. With ``text_col`` a request without text is not searched: one
    'rejected' row with the reason, the dead letter of the stream. Output
    (request_id, status, rank, id, distance, message)."""
    spoken = requests
    if text_col is not None:
        checked = validate_requests(requests.select("request_id", "query_key", F.col(text_col).alias("_text")), "_text", "_said")
        spoken = checked.where("status = 'ok'").select("request_id", "query_key")
        dead = checked.where("status <> 'ok'")
    keys = spoken.select("query_key").distinct()
    vec = vectors.join(keys, "query_key", "left_semi").withColumn(
        "_vs", vector_status("embedding", metric=metric)
    )
    good = vec.where(F.col("_vs") == "ok").select(F.col("query_key").alias("query_id"), "embedding")
    hits, bound = nearest(cases, good, [Route(k)], metric=metric, exclude_self=exclude_self, with_bound=True)
    # gate inside the (small) hit list: every query's rows carry its status,
    # so the kNN result is consumed by one join with the requests
    top1 = F.min("distance").over(Window.partitionBy("query_id"))
    scored = hits.drop("route").withColumn(
        "status", F.when(R.refused(top1, threshold), F.lit("refused")).otherwise(F.lit("ok"))
    ).withColumnRenamed("query_id", "query_key")
    # the hit list is bounded (distinct keys x k): broadcast it, so a key sent
    # by a large share of the requests does not skew the join
    if broadcastable(bound):
        scored = F.broadcast(scored)
    j = spoken.join(scored, "query_key", "left").where(
        F.col("status").isNull() | (F.col("status") == "ok") | (F.col("rank") == 1)
    )
    ok = F.col("status") == "ok"
    answers = j.select(
        "request_id",
        F.coalesce(F.col("status"), F.lit("error")).alias("status"),
        F.when(ok, F.col("rank")).alias("rank"),
        F.when(ok, F.col("id")).alias("id"),
        F.when(ok, F.round("distance", 4)).alias("distance"),
        F.when(F.col("status").isNull(), F.lit("no usable query vector"))
        .when(F.col("status") == "refused", F.lit(R.REFUSAL_MESSAGE))
        .alias("message"),
    )
    if text_col is None:
        return answers
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in answers.dtypes if c in ("rank", "id", "distance")]
    return answers.unionByName(dead.select("request_id", "status", *nothing, F.col("reason").alias("message")))


REPORT_COLUMNS = ["request_id", "status", "message", "target_id", "archetype", "outcome", "distance", "match_percent", "threat",
                  "matched_cases", "user_message"]


def report_requests(
    requests: DataFrame,
    cases: DataFrame,
    queries: DataFrame,
    *,
    text_col: str = "request",
    metric: str = "cosine",
    threshold: float | None = R.GATE_THRESHOLD,
    exclude_self: bool = True,
    case_template: str = P.CASE_TEMPLATE,
    user_template: str = P.USER_TEMPLATE,
) -> DataFrame:
    """The whole answer of a table of requests ``(request_id, query_key,
    text_col)``: validation, multi-route recall, gate, report and prompt.

    ``queries`` holds one row per key: (query_id, embedding, classified,
    q_industry, q_archetype); ``cases`` the columns of ``retrieve.multiroute``
    and funding_amount, archetype, industry and document. A key is searched
    once however many requests share it. One row per request (REPORT_COLUMNS):
    'ok' with its report, 'refused' (nearest case beyond ``threshold``; None
    lets all pass) with the message, 'error' where no case can be found for
    the key, 'rejected' where the text is missing or blank."""
    checked = validate_requests(
        requests.select("request_id", "query_key", F.col(text_col).alias("_text")), "_text", "_said")
    alive = checked.where("status = 'ok'").select("request_id", "query_key", "_said")
    wanted = queries.join(alive.select(F.col("query_key").alias("query_id")).distinct(), "query_id", "left_semi")
    found = R.multiroute(cases, wanted, metric=metric, exclude_self=exclude_self,
                         payload=["funding_amount", "archetype", "industry", "document"])
    sheets = P.sheet(found, case_template=case_template).withColumnRenamed("query_id", "_key")
    # AQE broadcasts the sheets by their real size or splits a key that many requests share
    j = alive.join(sheets, alive["query_key"].cast(sheets.schema["_key"].dataType) == F.col("_key"), "left")
    no = F.lit(False) if threshold is None else R.refused(F.col("top1_distance"), threshold)
    j = j.withColumn("status", F.when(F.col("_key").isNull(), F.lit("error")).when(no, F.lit("refused")).otherwise(F.lit("ok")))
    ok = F.col("status") == "ok"
    message = F.when(F.col("status") == "error", F.lit("no usable query vector")).when(
        F.col("status") == "refused", F.lit(R.REFUSAL_MESSAGE))
    answers = j.withColumn("user_message", P.user_message(F.col("_said"), F.col("case_text"), user_template)).select(
        "request_id", "status", message.alias("message"), *[F.when(ok, F.col(c)).alias(c) for c in REPORT_COLUMNS[3:]])
    nothing = [F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in REPORT_COLUMNS[3:]]
    dead = checked.where("status <> 'ok'").select("request_id", "status", F.col("reason").alias("message"), *nothing)
    return answers.unionByName(dead)


def read_requests(spark: SparkSession, schema, path: str, *, max_bytes: int = 256 << 20, glob: str | None = None) -> DataFrame:
    """Parquet requests as a stream whose micro-batches are bounded by the
    bytes of their files (at least one file each). ``path`` is a folder of files or
    a pattern; ``glob`` names the files to take from a folder."""
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def batch_writer(sink: str, answer: Callable[[DataFrame], DataFrame]):
    """foreachBatch body: answer the batch, overwrite its own partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # the batch is read by several small jobs (key count, vector block,
        # final write): keep it rather than re-reading the source
        batch.persist()
        try:
            answer(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def run_available(
    spark: SparkSession,
    source: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    held: tuple[DataFrame, ...] = (),
) -> DataFrame:
    """Process everything available now (then stop) and return the sink.
    ``held`` are tables that every micro-batch reads (the cases): they stay on
    the executors, by partition, from the first batch to the last; a lost
    partition is read again. A stream that never held a row gives an empty
    answer, with the columns of the others."""
    for table in held:
        table.persist()
    try:
        q = (
            source.writeStream.foreachBatch(batch_writer(sink, answer))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    finally:
        for table in held:
            table.unpersist()
    if q.exception() is not None:
        raise q.exception()
    try:
        return spark.read.parquet(sink)
    except AnalysisException:  # no batch yet, so no sink
        if q.lastProgress is not None and q.lastProgress["numInputRows"]:
            raise
        nothing = spark.createDataFrame([], source.schema)
        return answer(nothing).withColumn("batch_id", F.lit(0))
