"""Lookup / patch queries (J1-J5, S3) on customer, nation, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from precedent.operators import enrich as J
from precedent.plans.catalog import register
from precedent.plans.tables import read

# An example of an inline lookup, by order priority (two priorities are absent,
# so they fall back to the default).
PRIORITY_FUNDING = {"1-URGENT": "$90M", "2-HIGH": "$60M", "3-MEDIUM": "$30M"}


def _segment_lookup(spark, d):
    """Lookup built from customer: market segment -> customer name; names of
    customers in debt are blank (skipped); the highest custkey wins."""
    c = read(spark, d, "customer")
    src = c.select(
        "c_mktsegment",
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_name")).alias("v"),
        "c_custkey",
    )
    return J.build_lookup(src, "c_mktsegment", "v", "c_custkey")


# ---------------------------------------------------------------- J2
@register(
    "lookup_last_wins",
    """
SELECT c_mktsegment AS key, arg_max(c_name, c_custkey) AS value
FROM customer WHERE c_acctbal >= 0 AND c_name <> '' AND c_mktsegment <> ''
GROUP BY c_mktsegment""",
)
def lookup_last_wins(spark, d):
    return _segment_lookup(spark, d)


# ---------------------------------------------------------------- J1, S3
@register(
    "enrich_lookup_default",
    "SELECT o_orderkey, o_orderpriority, CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_FUNDING.items())
    + " ELSE 'Unknown' END AS funding_amount FROM orders",
)
def enrich_lookup_default(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    lk = J.literal_lookup(spark, PRIORITY_FUNDING)
    return J.enrich(o, lk, "o_orderpriority", "funding_amount")


def _customer_records(spark, d):
    """Customer rows shaped as case records: every fourth archetype is the
    'Unknown' placeholder, every sixth funding is missing, and every fifth nation
    key is one that no nation has."""
    c = read(spark, d, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.col("c_name").alias("company_name"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("Unknown")).otherwise(F.col("c_mktsegment")).alias("archetype"),
        F.when(F.col("c_custkey") % 6 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("$"), F.col("c_nationkey").cast("string"), F.lit("M")))
        .alias("funding_amount"),
    )


def _priority_lookup(spark, d):
    """custkey -> priority of the customer's latest order (last wins)."""
    o = read(spark, d, "orders")
    return J.build_lookup(o, "o_custkey", "o_orderpriority", "o_orderkey")


def _nation_funding(spark, d):
    """nationkey -> amount, for all nations."""
    n = read(spark, d, "nation")
    val = F.concat(
        F.lit("$"), F.col("n_nationkey").cast("string"),
        F.when(F.col("n_regionkey") % 2 == 0, F.lit("M")).otherwise(F.lit("B")),
    )
    return n.select(F.col("n_nationkey").cast("string").alias("key"), val.alias("value"))


RECORDS_SQL = """
WITH rec AS (
  SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey,
         c_name AS company_name,
         CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' ELSE c_mktsegment END AS archetype,
         CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '$' || CAST(customer.c_nationkey AS VARCHAR) || 'M' END AS funding_amount
  FROM customer),
plk AS (SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderpriority, o_orderkey) AS value
        FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '' GROUP BY o_custkey),
nlk AS (SELECT CAST(n_nationkey AS VARCHAR) AS key,
               '$' || CAST(n_nationkey AS VARCHAR) || CASE WHEN n_regionkey % 2 = 0 THEN 'M' ELSE 'B' END AS value
        FROM nation),
p1 AS (
  SELECT r.*, coalesce(r.archetype = 'Unknown' AND plk.value IS NOT NULL, false) AS patched,
         CASE WHEN r.archetype = 'Unknown' AND plk.value IS NOT NULL THEN plk.value ELSE r.archetype END AS archetype2
  FROM rec r LEFT JOIN plk ON plk.key = CAST(r.c_custkey AS VARCHAR)),
p2 AS (
  SELECT p1.*, coalesce(nlk.value, coalesce(funding_amount, '')) AS funding2,
         coalesce(nlk.value, coalesce(funding_amount, '')) IS DISTINCT FROM coalesce(funding_amount, '') AS changed
  FROM p1 LEFT JOIN nlk ON nlk.key = CAST(p1.c_nationkey AS VARCHAR))
"""


# ---------------------------------------------------------------- J3
@register(
    "patch_conditional",
    RECORDS_SQL + "SELECT c_custkey, archetype2 AS archetype, patched FROM p2",
)
def patch_conditional(spark, d):
    r = J.patch_conditional(_customer_records(spark, d), _priority_lookup(spark, d), "c_custkey", "archetype")
    return r.select("c_custkey", "archetype", "patched")


# ---------------------------------------------------------------- J4
@register(
    "patch_overwrite",
    RECORDS_SQL + "SELECT c_custkey, funding2 AS funding_amount, changed FROM p2",
)
def patch_overwrite(spark, d):
    r = J.patch_overwrite(_customer_records(spark, d), _nation_funding(spark, d), "c_nationkey", "funding_amount")
    return r.select("c_custkey", "funding_amount", "changed")


# ---------------------------------------------------------------- J5
@register(
    "patch_stats",
    RECORDS_SQL + """
SELECT count(*) FILTER (WHERE patched) AS archetype_fixed, count(*) FILTER (WHERE changed) AS funding_fixed,
       count(*) AS total FROM p2""",
)
def patch_stats(spark, d):
    r = J.patch_conditional(_customer_records(spark, d), _priority_lookup(spark, d), "c_custkey", "archetype")
    r = J.patch_overwrite(r, _nation_funding(spark, d), "c_nationkey", "funding_amount")
    return J.patch_stats(r, {"archetype_fixed": "patched", "funding_fixed": "changed"})
