"""Validation / audit queries (V1, V3, V4, V5, M16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from precedent.operators import quality as V
from precedent.plans.catalog import register
from precedent.plans.tables import QUERIES_SQL, cases, queries, read


# ---------------------------------------------------------------- V1, V3
@register(
    "request_validate",
    """
SELECT conv_id, turn, request,
       CASE WHEN t IS NULL OR request = '' THEN 'rejected' ELSE 'ok' END AS status,
       CASE WHEN t IS NULL THEN 'missing' WHEN request = '' THEN 'blank' END AS reason
FROM (SELECT conv_id, turn, t, regexp_replace(t, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS request
      FROM (SELECT conv_id, turn, text AS t FROM conversations UNION ALL
            SELECT conv_id, -1, CASE WHEN conv_id % 2 = 0 THEN chr(32) || chr(10) END FROM conversations WHERE role = 'system'))""",
)
def request_validate(spark, d):
    # whole texts of all turns, and for each system turn a request that is blank or missing
    c = read(spark, d, "conversations")
    bad = c.where(F.col("role") == "system").select(
        "conv_id", F.lit(-1).alias("turn"), F.when(F.col("conv_id") % 2 == 0, F.lit(" \n")).alias("t"))
    c = c.select("conv_id", "turn", F.col("text").alias("t")).unionByName(bad)
    return V.validate_requests(c, "t").select("conv_id", "turn", "request", "status", "reason")


# ---------------------------------------------------------------- V4
def _doc_cases(spark, d):
    """Documents as cases: the name is the source, the vector text the whole text."""
    doc = read(spark, d, "documents")
    return doc.select("doc_id", "lang", F.col("source").alias("name"), F.col("text").alias("body"))


@register(
    "audit_name_leak",
    """
SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE coalesce(contains(lower(body), lower(name)), false)) AS n_leaks
FROM (SELECT lang, source AS name, text AS body FROM documents)
GROUP BY lang""",
)
def audit_name_leak(spark, d):
    return V.audit_name_leak(_doc_cases(spark, d), "name", "body", by=["lang"])


# ---------------------------------------------------------------- V5
@register(
    "audit_modal_value",
    """
SELECT c_mktsegment AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 4) AS share,
       count(*) / (SELECT count(*) FROM customer) > 0.2 AS suspicious
FROM customer GROUP BY c_mktsegment""",
)
def audit_modal_value(spark, d):
    return V.audit_modal_value(read(spark, d, "customer"), "c_mktsegment", threshold=0.2)


# ---------------------------------------------------------------- M16
@register(
    "labels_out_of_domain",
    "WITH " + QUERIES_SQL.strip() + """
SELECT query_id, q_industry FROM queries
WHERE classified AND q_industry NOT IN (SELECT DISTINCT 'ind' || CAST(label AS VARCHAR) FROM embeddings)""",
)
def labels_out_of_domain(spark, d):
    # only answers that parsed are audited
    q = queries(spark, d).where(F.col("classified")).select("query_id", "q_industry")
    return V.out_of_domain(q, "q_industry", cases(spark, d), "industry")
