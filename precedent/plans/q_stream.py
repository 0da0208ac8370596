"""The request stream (T1) over ``events``, plus the text encoder (R11).

Each event is a request from its user; the user's query vector is the
embedding with vec_id = user_id. The stream reads the events table with
availableNow and writes per-batch partitions; the result read back equals the
batch answer for all events (the same SQL is the oracle).
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from precedent.operators import report as P
from precedent.plans.catalog import register
from precedent.plans.q_report import PERCENT_SQL, RESULTS_STEP_SQL, THREAT_SQL, flat_cases, sheet_sql
from precedent.plans.q_retrieve import multiroute_sql
from precedent.plans.tables import CASES_SQL, cases, queries, read, sql_cosine, sql_text
from precedent.session import scratch_dir
from precedent.streaming.requests import OUTPUT_COLUMNS, REPORT_COLUMNS, answer_requests, read_requests, report_requests, run_available

STREAM_SQL = f"""
WITH {CASES_SQL.strip()},
users AS (SELECT DISTINCT user_id FROM events),
pairs AS (
  SELECT u.user_id, c.id, {sql_cosine("e.embedding", "c.embedding")} AS d
  FROM users u JOIN embeddings e ON e.vec_id = u.user_id JOIN cases c ON c.id <> u.user_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, id) AS rank FROM pairs) WHERE rank <= 3),
gate AS (SELECT user_id, CASE WHEN min(d) > 0.65 THEN 'refused' ELSE 'ok' END AS status FROM top GROUP BY user_id)
SELECT ev.event_id AS request_id, g.status, CAST(t.rank AS BIGINT) AS rank, t.id, round(t.d, 4) AS distance,
       CAST(NULL AS VARCHAR) AS message
FROM events ev JOIN gate g ON g.user_id = ev.user_id JOIN top t ON t.user_id = ev.user_id
WHERE g.status = 'ok'
UNION ALL
SELECT ev.event_id, 'refused', NULL, NULL, NULL, '{{msg}}'
FROM events ev JOIN gate g ON g.user_id = ev.user_id WHERE g.status = 'refused'
UNION ALL
SELECT ev.event_id, 'error', NULL, NULL, NULL, 'no usable query vector'
FROM events ev WHERE ev.user_id NOT IN (SELECT vec_id FROM embeddings)"""


def _msg_sql() -> str:
    from precedent.operators.retrieve import REFUSAL_MESSAGE

    return STREAM_SQL.replace("{msg}", REFUSAL_MESSAGE.replace("'", "''"))


def _stream(spark, d, name):
    """A table as a stream of its files: the table may be one file or a folder of many
    (a stream takes a single file by a pattern only)."""
    return read_requests(spark, read(spark, d, name).schema, f"{d.rstrip('/')}/{{{name}.parquet}}")


@register("stream_retrieve", _msg_sql())
def stream_retrieve(spark, d):
    source = _stream(spark, d, "events")
    cs = cases(spark, d)
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_key"), "embedding")

    def answer(batch):
        reqs = batch.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("query_key"))
        return answer_requests(reqs, cs, vectors, k=3, metric="cosine")

    out = run_available(spark, source, answer, scratch_dir(spark, "stream-sink"), scratch_dir(spark, "stream-ckpt"))
    return out.select(*OUTPUT_COLUMNS)


# Turns of conversations as requests: the text of a request is its turn, and the vector of
# its conversation is the embedding with that number. System turns ask nothing.
TURNS_SQL = f"""
WITH {CASES_SQL.strip()},
turns AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN ' ' ELSE text END AS said FROM conversations),
said AS (SELECT *, NOT (said IS NULL OR regexp_replace(said, '[ \\t\\n\\r\\f]+', '', 'g') = '') AS ok FROM turns),
keys AS (SELECT DISTINCT conv_id FROM said WHERE ok),
pairs AS (
  SELECT u.conv_id, c.id, {sql_cosine("e.embedding", "c.embedding")} AS d
  FROM keys u JOIN embeddings e ON e.vec_id = u.conv_id JOIN cases c ON c.id <> u.conv_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY d, id) AS rank FROM pairs) WHERE rank <= 3),
gate AS (SELECT conv_id, CASE WHEN min(d) > 0.65 THEN 'refused' ELSE 'ok' END AS status FROM top GROUP BY conv_id),
name AS (SELECT *, concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS request_id FROM said)
SELECT n.request_id, g.status, CAST(t.rank AS BIGINT) AS rank, t.id, round(t.d, 4) AS distance, CAST(NULL AS VARCHAR) AS message
FROM name n JOIN gate g USING (conv_id) JOIN top t USING (conv_id) WHERE n.ok AND g.status = 'ok'
UNION ALL
SELECT n.request_id, 'refused', NULL, NULL, NULL, '{{msg}}' FROM name n JOIN gate g USING (conv_id) WHERE n.ok AND g.status = 'refused'
UNION ALL
SELECT n.request_id, 'error', NULL, NULL, NULL, 'no usable query vector'
FROM name n WHERE n.ok AND n.conv_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL
SELECT n.request_id, 'rejected', NULL, NULL, NULL, CASE WHEN n.said IS NULL THEN 'missing' ELSE 'blank' END FROM name n WHERE NOT n.ok"""


def _turns_sql() -> str:
    from precedent.operators.retrieve import REFUSAL_MESSAGE

    return TURNS_SQL.replace("{msg}", REFUSAL_MESSAGE.replace("'", "''"))


@register("stream_dead_letters", _turns_sql())
def stream_dead_letters(spark, d):
    """Every turn as a streamed request; those without text come back rejected."""
    source = _stream(spark, d, "conversations")
    cs = cases(spark, d)
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_key"), "embedding")

    def answer(batch):
        name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
        said = F.when(F.col("role") == "system", F.lit(" ")).otherwise(F.col("text"))
        reqs = batch.select(name.alias("request_id"), F.col("conv_id").alias("query_key"), said.alias("said"))
        return answer_requests(reqs, cs, vectors, k=3, metric="cosine", text_col="said")

    out = run_available(spark, source, answer, scratch_dir(spark, "stream-sink"), scratch_dir(spark, "stream-ckpt"))
    return out.select(*OUTPUT_COLUMNS)


# Every turn with its whole text, and one blank request per conversation, through the whole chain.
def _report_sql() -> str:
    from precedent.operators.retrieve import REFUSAL_MESSAGE

    nothing = "NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"
    return multiroute_sql("cosine") + RESULTS_STEP_SQL + "," + sheet_sql() + f""",
said AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_id, conv_id, text FROM conversations
         UNION ALL SELECT CAST(conv_id AS VARCHAR) || ':blank', conv_id, ' ' || chr(9) FROM conversations WHERE turn = 0),
trimmed AS (SELECT request_id, conv_id, text, regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS t FROM said),
j AS (SELECT t.*, s.* FROM trimmed t LEFT JOIN sheet s ON s.query_id = t.conv_id WHERE t.t <> '')
SELECT request_id, 'ok' AS status, CAST(NULL AS VARCHAR) AS message, target_id, archetype, outcome, round(top1, 4) AS distance,
       {PERCENT_SQL} AS match_percent, {THREAT_SQL} AS threat, matched_cases,
       {sql_text(P.USER_TEMPLATE, request="t", cases="case_text")} AS user_message
FROM j WHERE top1 <= 0.65
UNION ALL SELECT request_id, 'refused', '{REFUSAL_MESSAGE.replace("'", "''")}', {nothing} FROM j WHERE top1 > 0.65
UNION ALL SELECT request_id, 'error', 'no usable query vector', {nothing} FROM j WHERE query_id IS NULL
UNION ALL SELECT request_id, 'rejected', CASE WHEN text IS NULL THEN 'missing' ELSE 'blank' END, {nothing} FROM trimmed WHERE t IS NULL OR t = ''"""


@register("stream_report", _report_sql())
def stream_report(spark, d):
    """Requests as a stream: validated, recalled by all routes, gated, reported."""
    source = _stream(spark, d, "conversations")
    cs, qs = cases(spark, d), queries(spark, d)

    def answer(batch):
        conv = F.col("conv_id").cast("string")
        turns = batch.select(F.concat(conv, F.lit(":"), F.col("turn").cast("string")).alias("request_id"),
                             F.col("conv_id").alias("query_key"), F.col("text").alias("request"))
        blank = batch.where("turn = 0").select(F.concat(conv, F.lit(":blank")).alias("request_id"),
                                               F.col("conv_id").alias("query_key"), F.lit(" \t").alias("request"))
        return report_requests(turns.unionByName(blank), cs, qs)

    out = run_available(spark, source, answer, scratch_dir(spark, "stream-sink"), scratch_dir(spark, "stream-ckpt"), held=(cs,))
    return out.select(*REPORT_COLUMNS).withColumn("matched_cases", flat_cases())


# ---------------------------------------------------------------- R11 (rows only)
@register("encode_text")
def encode_text(spark, d):
    """Text -> unit vector with pyspark.ml (tokenise, hash to 64 buckets,
    L2-normalise): the default encoder for tables without vectors."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    tok = RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\W+", toLowercase=True)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=64)
    norm = Normalizer(inputCol="tf", outputCol="vec", p=2.0)
    out = norm.transform(tf.transform(tok.transform(docs)))
    return out.select("doc_id", vector_to_array("vec", "float32").alias("embedding"))
