"""Report queries (P1-P10) over multi-route / top-k results."""

from __future__ import annotations

from pyspark.sql import functions as F

from precedent.operators import documents as D
from precedent.operators import report as P
from precedent.operators import retrieve as R
from precedent.plans.catalog import register
from precedent.plans.q_retrieve import MULTIROUTE_SQL, WITH, _records, multiroute_sql
from precedent.plans.tables import CASES_SQL, QUERIES_SQL, cases, pairs_sql, queries, read, sql_text
from precedent.session import scratch_dir
from precedent.sources import versions as V

PAYLOAD = ["funding_amount", "archetype", "industry", "document"]


def _multiroute(spark, d):
    return R.multiroute(cases(spark, d), queries(spark, d), exclude_self=True, payload=PAYLOAD)


RESULTS_STEP_SQL = """,
results AS (
  SELECT a.query_id, row_number() OVER (PARTITION BY a.query_id ORDER BY a.d, a.route, a.id) AS rank, a.id, a.d,
         c.company_name, c.funding_amount, c.archetype, c.industry, c.document
  FROM allrows a JOIN cases c ON c.id = a.id)
"""
RESULTS_SQL = MULTIROUTE_SQL + RESULTS_STEP_SQL


def _between_sql(t: str) -> str:
    s, e = "'Reasons: '", "'. Archetype:'"
    return (
        f"CASE WHEN strpos({t}, {s}) > 0 AND strpos({t}, {e}) > 0 THEN "
        f"substring({t}, strpos({t}, {s}) + 9, greatest(0, strpos({t}, {e}) - (strpos({t}, {s}) + 9))) ELSE {t} END"
    )


_CASE_SQL = sql_text(P.CASE_TEMPLATE, rank="CAST(r.rank AS VARCHAR)", company_name="r.company_name", funding_amount="r.funding_amount",
                     archetype="r.archetype", document="r.document")
CASE_TEXT_SQL = f"string_agg({_CASE_SQL}, {sql_text(P.CASE_SEPARATOR)} ORDER BY r.rank)"


# ---------------------------------------------------------------- P1, P2
@register(
    "prompt_assemble",
    RESULTS_SQL + f"""
SELECT r.query_id, '{P.SYSTEM_PROMPT}' AS system_message, {sql_text(P.USER_TEMPLATE, request='q.query_text', cases=CASE_TEXT_SQL)} AS user_message
FROM results r JOIN queries q ON q.query_id = r.query_id
GROUP BY r.query_id, q.query_text""",
)
def prompt_assemble(spark, d):
    out = P.prompt_messages(_multiroute(spark, d), queries(spark, d))
    return out.select(
        "query_id",
        F.get(F.col("messages"), 0)["content"].alias("system_message"),
        F.get(F.col("messages"), 1)["content"].alias("user_message"),
    )


# ---------------------------------------------------------------- P3
@register(
    "prompt_single_match",
    WITH.replace("AS archetype,", "AS archetype0,", 1) + """,
c2 AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE archetype0 END AS archetype FROM cases),
qn AS (SELECT query_id, query_text, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM queries),
pairs AS (SELECT qn.query_id, qn.query_text, c.id, c.archetype, c.ultimate_outcome,
                 list_sum(list_transform(list_zip(qn.v, c.embedding), lambda x: (x[1] - x[2]::DOUBLE) ^ 2)) AS d
          FROM qn JOIN c2 c ON c.id <> qn.query_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rn FROM pairs) WHERE rn = 1),
rec AS (SELECT p_partkey AS id, arg_max(p_type, p_partkey) AS bias, arg_max(p_name, p_partkey) AS fatal, arg_max(p_brand, p_partkey) AS arch
        FROM part GROUP BY p_partkey)
SELECT t.query_id, """ + sql_text(
        P.MATCH_TEMPLATE, query_text="t.query_text", target_id="CAST(t.id AS VARCHAR)", archetype="coalesce(t.archetype, r.arch, '')",
        core_cognitive_bias="coalesce(r.bias, '')", fatal_action="coalesce(r.fatal, '')", outcome="t.ultimate_outcome") + """ AS prompt
FROM top t LEFT JOIN rec r ON r.id = t.id""",
)
def prompt_single_match(spark, d):
    c = cases(spark, d).withColumn("archetype", F.when(F.col("id") % 5 != 0, F.col("archetype")))
    q = queries(spark, d)
    top = R.top1_enriched(c, q, _records(spark, d), exclude_self=True)
    return P.single_match_prompt(top.join(q.select("query_id", "query_text"), "query_id"))


# ---------------------------------------------------------------- P4
@register(
    "report_summary",
    RESULTS_SQL + f"""
SELECT query_id, coalesce(company_name, 'Unknown') AS target_id, coalesce(archetype, 'Unknown') AS archetype,
       'Raised ' || coalesce(funding_amount, 'Unknown') || ', then failed: ' || {_between_sql('document')} AS outcome,
       round(d, 4) AS distance
FROM results WHERE rank = 1""",
)
def report_summary(spark, d):
    return P.summary(_multiroute(spark, d))


# ---------------------------------------------------------------- P5
MATCHED_SQL = f"""string_agg(company_name || '|' || archetype || '|' || industry || '|' || printf('%.4f', round(d, 4))
         || '|' || {_between_sql('document')}, ' || ' ORDER BY rank)"""


def flat_cases() -> F.Column:
    """The nested matches as one text, as the oracle writes them."""
    return F.array_join(
        F.transform(
            F.col("matched_cases"),
            lambda s: F.concat_ws(
                "|", s["company_name"], s["archetype"], s["industry"], F.format_string("%.4f", s["distance"]),
                s["failure_reasons"],
            ),
        ),
        " || ",
    )


@register(
    "report_matched_cases",
    RESULTS_SQL + f"SELECT query_id, {MATCHED_SQL} AS matched_cases, count(*) AS n_cases FROM results GROUP BY query_id",
)
def report_matched_cases(spark, d):
    m = P.matched_cases(_multiroute(spark, d))
    return m.select("query_id", flat_cases().alias("matched_cases"), F.size("matched_cases").cast("long").alias("n_cases"))


# ---------------------------------------------------------------- P6, P7
@register(
    "report_threat",
    WITH + "," + pairs_sql("cosine") + """
SELECT query_id, rank, round(d, 4) AS distance,
       CAST(least(100, greatest(0, floor((1.0 - d) * 100 + 0.5))) AS BIGINT) AS match_percent,
       CASE WHEN d < 0.5 THEN 'CRITICAL' WHEN d < 0.8 THEN 'HIGH' ELSE 'MODERATE' END AS threat
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs) WHERE rank <= 3""",
)
def report_threat(spark, d):
    res = R.topk(cases(spark, d), queries(spark, d), k=3, metric="cosine", exclude_self=True)
    return P.threat(res)


def sheet_sql() -> str:
    """The sheet of every query from ``results`` (oracle only)."""
    return f"""sheet AS (
  SELECT r.query_id, max(CASE WHEN r.rank = 1 THEN r.company_name END) AS target_id, max(CASE WHEN r.rank = 1 THEN r.archetype END) AS archetype,
         max(CASE WHEN r.rank = 1 THEN 'Raised ' || r.funding_amount || ', then failed: ' || {_between_sql('r.document')} END) AS outcome,
         min(r.d) AS top1, {MATCHED_SQL} AS matched_cases, {CASE_TEXT_SQL} AS case_text
  FROM results r GROUP BY r.query_id)"""


PERCENT_SQL = "CAST(least(100, greatest(0, floor((1.0 - top1) * 100 + 0.5))) AS BIGINT)"
THREAT_SQL = "CASE WHEN top1 < 0.5 THEN 'CRITICAL' WHEN top1 < 0.8 THEN 'HIGH' ELSE 'MODERATE' END"


# ---------------------------------------------------------------- D1, D3, S6, S7, R3, P1-P7
@register(
    "chain_report",
    multiroute_sql("cosine", f"""WITH named AS (SELECT vec_id, 'case_' || CAST(row_number() OVER (ORDER BY vec_id) - 1 AS VARCHAR) AS name FROM embeddings),
{CASES_SQL.strip().replace("cases AS", "plain_cases AS", 1)},
{QUERIES_SQL.strip().replace("queries AS", "plain_queries AS", 1)},
cases AS (SELECT c.* REPLACE (n.name AS id) FROM plain_cases c JOIN named n ON n.vec_id = c.id),
queries AS (SELECT q.* REPLACE (n.name AS query_id) FROM plain_queries q JOIN named n ON n.vec_id = q.query_id)""")
    + RESULTS_STEP_SQL + "," + sheet_sql() + f"""
SELECT s.query_id, s.target_id, s.archetype, s.outcome, round(s.top1, 4) AS distance, {PERCENT_SQL} AS match_percent, {THREAT_SQL} AS threat,
       s.matched_cases, {sql_text(P.USER_TEMPLATE, request="q.query_text", cases="s.case_text")} AS user_message
FROM sheet s JOIN queries q USING (query_id)""",
)
def chain_report(spark, d):
    """From records to reports: documents are built, numbered with text ids, written
    as a collection, opened again, and every vector is reported against all others."""
    records = cases(spark, d).drop("document")
    built = D.assign_ids(D.build_document(records.withColumnRenamed("id", "vec_id")), ["vec_id"], out="id")
    base = scratch_dir(spark, "chain")
    V.create(built.drop("metadata"), base)
    stored = V.open_version(spark, base)
    q = queries(spark, d).withColumnRenamed("query_id", "vec_id").join(stored.select("vec_id", F.col("id").alias("query_id")), "vec_id")
    found = R.multiroute(stored, q, metric="cosine", exclude_self=True, payload=PAYLOAD)
    out = P.sheet(found).join(q.select("query_id", "query_text"), "query_id")
    return out.select("query_id", "target_id", "archetype", "outcome", "distance", "match_percent", "threat",
                      flat_cases().alias("matched_cases"), P.user_message(F.col("query_text"), F.col("case_text")).alias("user_message"))


# ---------------------------------------------------------------- P8, P9
@register(
    "report_tags",
    RESULTS_SQL + """
SELECT query_id, rank, '#' || substring(regexp_replace(upper(coalesce(company_name, '')), '\\s+', '_', 'g'), 1, 20) || '-CASE' AS subject_tag,
       'Case_' || CASE WHEN rank < 10 THEN lpad(CAST(rank AS VARCHAR), 2, '0') ELSE CAST(rank AS VARCHAR) END AS card_label
FROM results""",
)
def report_tags(spark, d):
    return P.tags(_multiroute(spark, d))


# ---------------------------------------------------------------- P10
@register(
    "report_lines",
    """
SELECT conv_id, turn, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT conv_id, turn, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line
  FROM (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$')) AS ls
        FROM conversations))""",
)
def report_lines(spark, d):
    conv = read(spark, d, "conversations")
    return P.lines(conv, ["conv_id", "turn"]).withColumn("line_no", F.col("line_no").cast("long"))
