"""Validation and data-quality audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Whitespace class shared with the SQL oracle (Java and RE2 agree on it).
WS = "[ \\t\\n\\r\\f]"


def strip_ws(c: F.Column) -> F.Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def validate_requests(df: DataFrame, text_col: str, out_col: str = "request") -> DataFrame:
    """Trim the request text; blank or null requests are rejected with a reason
    instead of failing the job. Adds ``out_col`` (trimmed), ``status`` and
    ``reason``."""
    t = strip_ws(F.col(text_col))
    status = F.when(F.col(text_col).isNull(), F.lit("rejected")).when(t == "", F.lit("rejected")).otherwise(F.lit("ok"))
    reason = F.when(F.col(text_col).isNull(), F.lit("missing")).when(t == "", F.lit("blank"))
    return df.withColumn(out_col, t).withColumn("status", status).withColumn("reason", reason)


def name_leak(df: DataFrame, name_col: str, doc_col: str) -> F.Column:
    """Row flag: the name occurs in the document (case-insensitive)."""
    return F.coalesce(F.contains(F.lower(F.col(doc_col)), F.lower(F.col(name_col))), F.lit(False))


def audit_name_leak(df: DataFrame, name_col: str, doc_col: str, by: list[str] | None = None) -> DataFrame:
    """Count of documents that contain their own name, per group."""
    flag = name_leak(df, name_col, doc_col)
    g = df.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(flag).alias("n_leaks"))


def audit_modal_value(df: DataFrame, col: str, threshold: float = 0.5) -> DataFrame:
    """Share of each value of ``col``; ``suspicious`` when the share exceeds
    ``threshold`` (a placeholder repeated over most rows)."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    return counts.select(
        "value", "n",
        F.round(F.col("n") / total, 4).alias("share"),
        (F.col("n") / total > F.lit(threshold)).alias("suspicious"),
    )


def out_of_domain(answers: DataFrame, answer_col: str, domain: DataFrame, domain_col: str) -> DataFrame:
    """Answers whose value is not among the distinct values of the domain
    table (the allowed label list is data, not a constant)."""
    dom = domain.select(F.col(domain_col).alias("_v")).distinct()
    return answers.join(dom, F.col(answer_col) == F.col("_v"), "left_anti")
