"""Document build (vector text + metadata) and consecutive id assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precedent.functions.text import between_markers
from precedent.session import scratch_dir

# The document template's labels. between_markers with
# REASONS_START / REASONS_END recovers the reasons segment.
INDUSTRY_LABEL = "Industry: "
REASONS_START = "Reasons: "
REASONS_END = ". Archetype:"


def document_text(industry, reasons, archetype) -> F.Column:
    """'Industry: I. Reasons: R. Archetype: A.' (the name is left out)."""
    return F.concat(
        F.lit(INDUSTRY_LABEL), industry, F.lit(". " + REASONS_START), reasons,
        F.lit(REASONS_END + " "), archetype, F.lit("."),
    )


def build_document(
    df: DataFrame,
    *,
    name: str = "company_name",
    industry: str = "industry",
    reasons: str = "failure_reasons",
    archetype: str = "archetype",
    funding: str = "funding_amount",
    strict: bool = True,
) -> DataFrame:
    """Adds ``document`` and ``metadata`` struct<company_name, funding_amount,
    archetype, industry>. With ``strict`` a missing field fails the job, as the
    reference's KeyError does; otherwise the document is null."""
    doc = document_text(F.col(industry), F.col(reasons), F.col(archetype))
    if strict:
        missing = F.col(industry).isNull() | F.col(reasons).isNull() | F.col(archetype).isNull()
        doc = F.when(missing, F.raise_error(F.lit("document field missing"))).otherwise(doc)
    meta = F.struct(
        F.col(name).alias("company_name"), F.col(funding).alias("funding_amount"),
        F.col(archetype).alias("archetype"), F.col(industry).alias("industry"),
    )
    return df.withColumn("document", doc).withColumn("metadata", meta)


def extract_reasons(document) -> F.Column:
    d = F.col(document) if isinstance(document, str) else document
    return between_markers(d, REASONS_START, REASONS_END)


def assign_positions(df: DataFrame, order_cols: list[str], out: str = "pos") -> DataFrame:
    """0-based consecutive position in ``order_cols`` order, computed without a
    single-partition window: range-partition and sort, number rows inside each
    partition, and add the row count of all earlier partitions (a table of one
    row per partition). The numbered rows are written below the shared
    checkpoint folder first: range bounds are drawn anew whenever a plan is
    evaluated, so counts and rows must come from one evaluation.
    ``order_cols`` must be unique for a stable result."""
    spark = df.sparkSession
    part = (
        df.repartitionByRange(*[F.col(c) for c in order_cols])
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
        .withColumn("_rn", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    path = scratch_dir(spark, "positions")
    part.write.parquet(path)
    part = spark.read.schema(part.schema).parquet(path)
    counts = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, ["_off"])
    return (
        part.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_pid", "_rn", "_off")
    )


def assign_ids(df: DataFrame, order_cols: list[str], prefix: str = "case_", out: str = "doc_id") -> DataFrame:
    """'prefix{position}' ids, positions 0-based in ``order_cols`` order."""
    return assign_positions(df, order_cols, "_pos").withColumn(
        out, F.concat(F.lit(prefix), F.col("_pos").cast("string"))
    ).drop("_pos")
