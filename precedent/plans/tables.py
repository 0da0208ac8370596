"""Reference-shaped tables derived from the driver tables.

Every derivation is a projection of whole tables (no row subsets); the SQL
text next to each one is the same derivation for the DuckDB oracle, so the
two sides read identical inputs.

Cases (the collection) come from ``embeddings``: the vector is the case
vector, the label is the industry, and the company, archetype and funding are
functions of the id (40 companies, so one company owns several vectors and the
company-level dedupe has work to do). Queries are the same vectors, each
searched against all the others (a query never matches itself).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

N_COMPANIES = 40
N_ARCHETYPES = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    company = F.concat(F.lit("c"), _s(F.col("vec_id") % N_COMPANIES))
    industry = F.concat(F.lit("ind"), _s("label"))
    archetype = F.concat(F.lit("arc"), _s(F.col("vec_id") % N_ARCHETYPES))
    reasons = F.concat(F.lit("Case "), _s("vec_id"), F.lit(" burned its runway on "), industry, F.lit("."))
    return e.select(
        F.col("vec_id").alias("id"),
        "embedding",
        company.alias("company_name"),
        industry.alias("industry"),
        archetype.alias("archetype"),
        F.concat(F.lit("$"), _s(F.col("vec_id") % N_COMPANIES + 1), F.lit("M")).alias("funding_amount"),
        reasons.alias("failure_reasons"),
        F.concat(
            F.lit("Industry: "), industry, F.lit(". Reasons: "), reasons, F.lit(". Archetype: "), archetype, F.lit(".")
        ).alias("document"),
        # persona-style outcome text of the older collection
        F.concat(F.lit("Closed after "), _s(F.col("vec_id") % 12 + 1), F.lit(" years.")).alias("ultimate_outcome"),
    )


CASES_SQL = f"""
cases AS (
  SELECT vec_id AS id, embedding,
         'c' || CAST(vec_id % {N_COMPANIES} AS VARCHAR) AS company_name,
         'ind' || CAST(label AS VARCHAR) AS industry,
         'arc' || CAST(vec_id % {N_ARCHETYPES} AS VARCHAR) AS archetype,
         '$' || CAST(vec_id % {N_COMPANIES} + 1 AS VARCHAR) || 'M' AS funding_amount,
         'Case ' || CAST(vec_id AS VARCHAR) || ' burned its runway on ind' || CAST(label AS VARCHAR) || '.' AS failure_reasons,
         'Industry: ind' || CAST(label AS VARCHAR) || '. Reasons: Case ' || CAST(vec_id AS VARCHAR)
           || ' burned its runway on ind' || CAST(label AS VARCHAR) || '.' || '. Archetype: arc'
           || CAST(vec_id % {N_ARCHETYPES} AS VARCHAR) || '.' AS document,
         'Closed after ' || CAST(vec_id % 12 + 1 AS VARCHAR) || ' years.' AS ultimate_outcome
  FROM embeddings
)"""


def classification_answer() -> F.Column:
    """The model's classification answer per vector (an input, as a model
    answer would be): prose for every third id, a fenced object for every
    eleventh, an out-of-domain industry for every seventh, no industry for
    every thirteenth, else the vector's own label and a derived archetype."""
    v = F.col("vec_id")
    arc = F.concat(F.lit('"archetype": "arc'), _s(F.col("label") % N_ARCHETYPES), F.lit('"'))
    ind = F.concat(F.lit('"industry": "ind'), _s("label"), F.lit('"'))
    return (
        F.when(v % 3 == 0, F.lit("I cannot tell."))
        .when(v % 11 == 0, F.concat(F.lit("```json\n{"), ind, F.lit(", "), arc, F.lit("}\n```")))
        .when(v % 7 == 0, F.concat(F.lit('{"industry": "ind_none", '), arc, F.lit("}")))
        .when(v % 13 == 0, F.concat(F.lit("{"), arc, F.lit("}")))
        .otherwise(F.concat(F.lit("  {"), ind, F.lit(", "), arc, F.lit("}\n")))
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query, classified by parsing its answer text
    (strict whole-text JSON; an unparsable answer leaves it unclassified)."""
    from precedent.operators.responses import parse_classification

    e = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        "embedding",
        F.concat(F.lit("idea "), _s("vec_id")).alias("query_text"),
        classification_answer().alias("answer"),
    )
    p = parse_classification(e, "answer")
    return p.select(
        "query_id", "embedding", "query_text", "classified",
        F.col("industry").alias("q_industry"), F.col("archetype").alias("q_archetype"),
    )


QUERIES_SQL = f"""
queries AS (
  SELECT vec_id AS query_id, embedding, 'idea ' || CAST(vec_id AS VARCHAR) AS query_text,
         (vec_id % 3 <> 0 AND vec_id % 11 <> 0) AS classified,
         CASE WHEN vec_id % 3 = 0 OR vec_id % 11 = 0 THEN NULL
              WHEN vec_id % 7 = 0 THEN 'ind_none'
              WHEN vec_id % 13 = 0 THEN ''
              ELSE 'ind' || CAST(label AS VARCHAR) END AS q_industry,
         CASE WHEN vec_id % 3 <> 0 AND vec_id % 11 <> 0 THEN 'arc' || CAST(label % {N_ARCHETYPES} AS VARCHAR) END AS q_archetype
  FROM embeddings
)"""


def sql_sq_l2(a: str, b: str) -> str:
    """Squared L2 in double, evaluated per pair (oracle only)."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ^ 2))"


def sql_cosine(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
    na = f"sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"
    nb = f"sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE)))"
    return f"(1.0 - {dot} / ({na} * {nb}))"


def pairs_sql(metric: str = "sql2", query_cols: str = "", case_cols: str = "") -> str:
    """All (query, case) pairs with their distance, self pairs excluded (oracle only)."""
    dist = sql_sq_l2("q.embedding", "c.embedding") if metric == "sql2" else sql_cosine("q.embedding", "c.embedding")
    qc = "".join(f", q.{c}" for c in query_cols.split()) if query_cols else ""
    cc = "".join(f", c.{c}" for c in case_cols.split()) if case_cols else ""
    return f"""
pairs AS (
  SELECT q.query_id, c.id{qc}{cc}, {dist} AS d
  FROM queries q JOIN cases c ON c.id <> q.query_id
)"""


def sql_text(template: str, **fields: str) -> str:
    """SQL of a text template: each {name} replaced by its expression (oracle only)."""
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, expr in fields.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return "(" + out + ")"
