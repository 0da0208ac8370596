"""Document build, ids, marker extraction (D1-D4) and collection I/O (S1, S7, S9,
S5, S6, S8, V2) on part."""

from __future__ import annotations

from pyspark.sql import functions as F

from precedent.operators import documents as D
from precedent.plans.catalog import register
from precedent.plans.tables import read
from precedent.session import scratch_dir
from precedent.sources import collection as S
from precedent.sources import json_arrays, json_io
from precedent.sources import versions as V


def part_records(spark, d):
    """Part rows shaped as cleansed case records."""
    p = read(spark, d, "part")
    return p.select(
        "p_partkey",
        F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("company_name"),
        F.col("p_type").alias("industry"),
        F.concat(F.col("p_name"), F.lit(" stalled at size "), F.col("p_size").cast("string"), F.lit(".")).alias(
            "failure_reasons"
        ),
        F.format_string("$%.2f", F.col("p_retailprice")).alias("funding_amount"),
        F.col("p_brand").alias("archetype"),
    )


PART_SQL = """
WITH rec AS (
  SELECT p_partkey, 'Part ' || CAST(p_partkey AS VARCHAR) AS company_name, p_type AS industry,
         p_name || ' stalled at size ' || CAST(p_size AS VARCHAR) || '.' AS failure_reasons,
         printf('$%.2f', p_retailprice) AS funding_amount, p_brand AS archetype
  FROM part),
docs AS (
  SELECT *, 'Industry: ' || industry || '. Reasons: ' || failure_reasons || '. Archetype: ' || archetype || '.' AS document
  FROM rec)
"""


# ---------------------------------------------------------------- D1, D2
@register(
    "document_build",
    PART_SQL + """
SELECT p_partkey, document, company_name AS meta_company_name, funding_amount AS meta_funding_amount,
       archetype AS meta_archetype, industry AS meta_industry FROM docs""",
)
def document_build(spark, d):
    out = D.build_document(part_records(spark, d))
    return out.select(
        "p_partkey", "document",
        F.col("metadata.company_name").alias("meta_company_name"),
        F.col("metadata.funding_amount").alias("meta_funding_amount"),
        F.col("metadata.archetype").alias("meta_archetype"),
        F.col("metadata.industry").alias("meta_industry"),
    )


# ---------------------------------------------------------------- D3
@register(
    "document_ids",
    PART_SQL + """
SELECT p_partkey, document, industry, failure_reasons, 'case_' || CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS VARCHAR) AS doc_id
FROM docs""",
)
def document_ids(spark, d):
    p = D.build_document(part_records(spark, d)).select("p_partkey", "document", "industry", "failure_reasons")
    return D.assign_ids(p, ["p_partkey"], prefix="case_")


# ---------------------------------------------------------------- D4
@register(
    "document_extract_between",
    PART_SQL + """
SELECT p_partkey,
       CASE WHEN strpos(document, 'Reasons: ') > 0 AND strpos(document, '. Archetype:') > 0
            THEN substring(document, strpos(document, 'Reasons: ') + 9,
                           greatest(0, strpos(document, '. Archetype:') - (strpos(document, 'Reasons: ') + 9)))
            ELSE document END AS failure_reasons,
       failure_reasons AS original
FROM docs""",
)
def document_extract_between(spark, d):
    out = D.build_document(part_records(spark, d))
    return out.select("p_partkey", D.extract_reasons("document").alias("failure_reasons"),
                      F.col("failure_reasons").alias("original"))


# ---------------------------------------------------------------- S6, S8, V2
@register(
    "collection_rebuild_count",
    "SELECT count(*) AS source_count, count(*) AS written_count, true AS ok FROM part",
)
def collection_rebuild_count(spark, d):
    docs = D.build_document(part_records(spark, d))
    return S.rebuild_and_check(docs, partition_by="industry")


# ---------------------------------------------------------------- S7, S9
@register(
    "collection_patch",
    """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)),
old AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS industry FROM customer),
new AS (
  SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'OVERDRAWN' ELSE c_mktsegment END AS industry
  FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
  UNION ALL SELECT -s_suppkey - 1, s_name, 'SUPPLIER' FROM supplier)
SELECT 1 AS version, id, name, industry, (SELECT count(*) FROM old) AS n_rows FROM old
UNION ALL SELECT 2, id, name, industry, (SELECT count(*) FROM new) FROM new""",
)
def collection_patch(spark, d):
    """Customers as a collection; a patch marks the overdrawn, adds the suppliers and
    removes customers without orders. Both versions as they are opened again."""
    base = scratch_dir(spark, "versions")
    customers = read(spark, d, "customer")
    rows = customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"),
                            "c_acctbal")
    added = read(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("name"),
                                              F.lit("SUPPLIER").alias("industry"))
    gone = rows.join(read(spark, d, "orders"), F.col("id") == F.col("o_custkey"), "left_anti").select("id")
    marked = rows.where("c_acctbal < 0").withColumn("industry", F.lit("OVERDRAWN")).drop("c_acctbal")
    V.create(rows.drop("c_acctbal"), base)
    V.patch(spark, base, rows=marked.unionByName(added), gone=gone)
    out = None
    for v in V.versions(spark, base):
        one = V.open_version(spark, base, v).select(
            F.lit(v).alias("version"), "id", "name", "industry", F.lit(V.manifest(spark, base, v).count).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- S1, S5
@register(
    "io_json_roundtrip",
    PART_SQL + "SELECT p_partkey, company_name, industry, failure_reasons, funding_amount, archetype FROM rec",
)
def io_json_roundtrip(spark, d):
    path = json_io.write_records(part_records(spark, d), scratch_dir(spark, "records-json"))
    schema = "p_partkey long, company_name string, industry string, failure_reasons string, funding_amount string, archetype string"
    return json_io.read_records(spark, path, schema, multiline=False)


@register(
    "io_json_arrays",
    PART_SQL + """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey, company_name, industry, failure_reasons,
       funding_amount, archetype FROM rec""",
)
def io_json_arrays(spark, d):
    """Records written as JSON arrays in order and read back by split, numbered in that order."""
    path = json_arrays.write_arrays(part_records(spark, d).orderBy("p_partkey"), scratch_dir(spark, "records-arrays"))
    schema = "p_partkey long, company_name string, industry string, failure_reasons string, funding_amount string, archetype string"
    return json_arrays.read_arrays(spark, path, schema, with_position=True)
