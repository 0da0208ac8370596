"""Retrieval queries over the derived case/query tables (embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from precedent.functions.vectors import normalise
from precedent.operators import retrieve as R
from precedent.plans.catalog import register
from precedent.plans.tables import CASES_SQL, QUERIES_SQL, cases, pairs_sql, queries, read, sql_sq_l2

WITH = f"WITH {CASES_SQL},\n{QUERIES_SQL}"


def _round(df, col="distance"):
    return df.withColumn(col, F.round(F.col(col), 4))


# ---------------------------------------------------------------- R1 / R12 / J8
@register(
    "retrieve_topk",
    WITH + "," + pairs_sql("sql2", case_cols="company_name") + """
SELECT query_id, rank, id, company_name, round(d, 4) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs)
WHERE rank <= 3""",
)
def retrieve_topk(spark, d):
    out = R.topk(cases(spark, d), queries(spark, d), k=3, exclude_self=True, payload=["company_name"])
    return _round(out).select("query_id", "rank", "id", "company_name", "distance")


# ---------------------------------------------------------------- J8, R1: lengths and status
def _damaged(df, key, vec="embedding"):
    """Half-length vectors for every fifth row; null, empty, non-finite and odd-length ones."""
    v, i = F.col(vec), F.col(key)
    return df.withColumn(vec, F.when(i % 5 == 1, F.slice(v, 1, 32)).when(i % 35 == 2, F.lit(None)).when(i % 35 == 3, F.slice(v, 1, 0))
                         .when(i % 35 == 4, F.concat(F.array(F.lit("inf").cast("float")), F.slice(v, 2, 63)))
                         .when(i % 35 == 7, F.slice(v, 1, 7)).otherwise(v))


def _damaged_sql(key):
    return f"""CASE WHEN {key} % 5 = 1 THEN embedding[1:32] WHEN {key} % 35 = 2 THEN NULL WHEN {key} % 35 = 3 THEN embedding[1:0]
      WHEN {key} % 35 = 4 THEN list_concat(['inf'::FLOAT], embedding[2:64]) WHEN {key} % 35 = 7 THEN embedding[1:7] ELSE embedding END"""


@register(
    "retrieve_status",
    WITH + f""",
q AS (SELECT query_id, {_damaged_sql('query_id')} AS v FROM queries),
c AS (SELECT id, CASE WHEN id % 5 = 1 THEN embedding[1:32] ELSE embedding END AS v FROM cases),
s AS (SELECT *, CASE WHEN v IS NULL THEN 'null_vector' WHEN len(list_filter(v, lambda x: NOT isfinite(x))) > 0 THEN 'not_finite'
      WHEN len(v) = 0 THEN 'wrong_length' END AS bad FROM q),
p AS (SELECT s.query_id, c.id, {sql_sq_l2('s.v', 'c.v')} AS d FROM s JOIN c ON len(s.v) = len(c.v) AND c.id <> s.query_id WHERE bad IS NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM p QUALIFY rank <= 2)
SELECT s.query_id, CASE WHEN bad IS NULL AND rank IS NOT NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN bad IS NOT NULL THEN bad WHEN rank IS NULL THEN 'no_case' END AS reason, rank, id, round(d, 4) AS distance
FROM s LEFT JOIN t USING (query_id)""",
)
def retrieve_status(spark, d):
    q = _damaged(queries(spark, d), "query_id")
    c = cases(spark, d).withColumn("embedding", F.when(F.col("id") % 5 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    hits = R.topk(c, q, k=2, exclude_self=True)
    return _round(R.query_status(q, hits).join(hits, "query_id", "left")).select(
        "query_id", "status", "reason", "rank", "id", "distance")


# ---------------------------------------------------------------- R2
@register(
    "retrieve_filtered_top1",
    WITH + "," + pairs_sql("sql2", query_cols="q_industry", case_cols="industry company_name") + """
SELECT query_id, id, company_name, round(d, 4) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rn FROM pairs WHERE industry = q_industry)
WHERE rn = 1""",
)
def retrieve_filtered_top1(spark, d):
    out = R.filtered_top1(cases(spark, d), queries(spark, d), "industry", "q_industry", exclude_self=True,
                          payload=["company_name"])
    return _round(out).select("query_id", "id", "company_name", "distance")


MULTIROUTE_STEPS_SQL = """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS g,
         CASE WHEN classified AND industry = q_industry
              THEN row_number() OVER (PARTITION BY query_id, (classified AND industry = q_industry) ORDER BY d, id) END AS r1,
         CASE WHEN classified AND archetype = q_archetype
              THEN row_number() OVER (PARTITION BY query_id, (classified AND archetype = q_archetype) ORDER BY d, id) END AS r2
  FROM pairs),
routed AS (
  SELECT query_id, 1 AS route, id, company_name, d FROM ranked WHERE r1 = 1
  UNION ALL SELECT query_id, 2, id, company_name, d FROM ranked WHERE r2 = 1
  UNION ALL SELECT query_id, 3, id, company_name, d FROM ranked WHERE g = 1 AND classified),
merged AS (
  SELECT query_id, route, id, company_name, d FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(company_name, '') ORDER BY route) AS f FROM routed)
  WHERE f = 1),
fallback AS (
  SELECT query_id, 3 AS route, id, company_name, d FROM ranked
  WHERE g <= 3 AND (NOT classified OR query_id NOT IN (SELECT query_id FROM merged))),
allrows AS (SELECT * FROM merged UNION ALL SELECT * FROM fallback)
"""


def multiroute_sql(metric: str = "sql2", tables: str = WITH) -> str:
    cols = {"query_cols": "classified q_industry q_archetype", "case_cols": "company_name industry archetype"}
    return tables + "," + pairs_sql(metric, **cols) + MULTIROUTE_STEPS_SQL


MULTIROUTE_SQL = multiroute_sql()


# ---------------------------------------------------------------- R2-R5, M15
@register(
    "retrieve_multiroute",
    MULTIROUTE_SQL + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, route, id) AS rank, route, id,
       round(d, 4) AS distance, company_name
FROM allrows""",
)
def retrieve_multiroute(spark, d):
    out = R.multiroute(cases(spark, d), queries(spark, d), exclude_self=True)
    return _round(out).select("query_id", "rank", "route", "id", "distance", "company_name")


# ---------------------------------------------------------------- R6, R7
@register(
    "retrieve_fallback",
    MULTIROUTE_SQL + """,
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, route, id) AS rank FROM allrows)
SELECT f.query_id, f.rank, f.id, round(f.d, 4) AS distance, f.company_name
FROM final f JOIN queries q ON q.query_id = f.query_id
WHERE NOT q.classified OR f.query_id NOT IN (SELECT query_id FROM merged)""",
)
def retrieve_fallback(spark, d):
    out = R.multiroute(cases(spark, d), queries(spark, d), exclude_self=True).where(F.col("fallback"))
    return _round(out).select("query_id", "rank", "id", "distance", "company_name")


# ---------------------------------------------------------------- R8
GATE_SQL = WITH + "," + pairs_sql("cosine") + """,
top AS (SELECT query_id, min(d) AS d1 FROM pairs GROUP BY query_id)
SELECT query_id, CASE WHEN d1 > 0.65 THEN 'refused' ELSE 'ok' END AS status,
       round(d1, 4) AS top1_distance
FROM top"""


@register("retrieve_gate", GATE_SQL)
def retrieve_gate(spark, d):
    res = R.topk(cases(spark, d), queries(spark, d), k=1, metric="cosine", exclude_self=True)
    g = R.gate(res, threshold=0.65)
    return g.select("query_id", "status", F.round("top1_distance", 4).alias("top1_distance"))


# ---------------------------------------------------------------- R9
@register(
    "retrieve_matched_names",
    WITH + "," + pairs_sql("sql2", case_cols="company_name") + """
SELECT query_id, string_agg(coalesce(company_name, 'N/A'), ', ' ORDER BY rank) AS matched_names,
       count(*) AS n_matches
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs)
WHERE rank <= 3 GROUP BY query_id""",
)
def retrieve_matched_names(spark, d):
    res = R.topk(cases(spark, d), queries(spark, d), k=3, exclude_self=True, payload=["company_name"])
    return R.matched_names(res)


# ---------------------------------------------------------------- R10
@register(
    "vector_normalise",
    """
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2,
       round(v[1], 6) AS first_component
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v
      FROM embeddings)""",
)
def vector_normalise(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", normalise("embedding").alias("v"))
    return e.select(
        "vec_id",
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"),
        F.round(F.get(F.col("v"), 0), 6).alias("first_component"),
    )


# ---------------------------------------------------------------- J6, J7, P11
def _records(spark, d):
    """Persona records keyed by target id, from part (one per key; the
    position column decides duplicates)."""
    p = read(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("target_id"),
        F.col("p_partkey").alias("pos"),
        F.col("p_type").alias("core_cognitive_bias"),
        F.col("p_name").alias("fatal_action"),
        F.col("p_brand").alias("archetype"),
    )


@register(
    "retrieve_top1_enriched",
    f"WITH {CASES_SQL.replace('AS archetype,', 'AS archetype0,')},\n{QUERIES_SQL}" + """,
c2 AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE archetype0 END AS archetype FROM cases),
qn AS (SELECT query_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM queries),
pairs AS (SELECT qn.query_id, c.id, c.archetype, c.ultimate_outcome,
                 list_sum(list_transform(list_zip(qn.v, c.embedding), lambda x: (x[1] - x[2]::DOUBLE) ^ 2)) AS d
          FROM qn JOIN c2 c ON c.id <> qn.query_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rn FROM pairs) WHERE rn = 1),
rec AS (SELECT p_partkey AS id, arg_max(p_type, p_partkey) AS core_cognitive_bias, arg_max(p_name, p_partkey) AS fatal_action,
               arg_max(p_brand, p_partkey) AS archetype FROM part GROUP BY p_partkey)
SELECT t.query_id, t.id AS target_id, coalesce(t.archetype, r.archetype, '') AS archetype,
       coalesce(r.core_cognitive_bias, '') AS core_cognitive_bias, coalesce(r.fatal_action, '') AS fatal_action,
       t.ultimate_outcome AS outcome, round(t.d, 4) AS distance
FROM top t LEFT JOIN rec r ON r.id = t.id""",
)
def retrieve_top1_enriched(spark, d):
    c = cases(spark, d).withColumn("archetype", F.when(F.col("id") % 5 != 0, F.col("archetype")))
    out = R.top1_enriched(c, queries(spark, d), _records(spark, d), exclude_self=True)
    return _round(out)
