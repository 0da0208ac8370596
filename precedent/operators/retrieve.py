"""Retrieval operators: global top-k, filtered top-1, multi-route recall with
dedupe and fallback, confidence gate, matched-name list, enriched top-1.

Case table columns used: ``id`` (integer or text), the vector, ``company_name`` and the
route label columns. Query table: ``query_id`` (unique), the vector and the
classification columns. All outputs are long form, one row per
(query, rank); ranks start at 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precedent.functions.vectors import normalise, vector_status
from precedent.operators.knn import Route, attach, broadcastable, nearest

GATE_THRESHOLD = 0.65
REFUSAL_MESSAGE = "The case base does not cover this scenario; describe a more specific venture."


def topk(
    cases: DataFrame,
    queries: DataFrame,
    k: int = 3,
    *,
    metric: str = "sql2",
    exclude_self: bool = False,
    payload: list[str] | None = None,
    case_vec: str = "embedding",
    query_vec: str = "embedding",
) -> DataFrame:
    """Global top-k by ascending distance: (query_id, rank, id, distance, payload...)."""
    hits, bound = nearest(
        cases, queries, [Route(k)], metric=metric, exclude_self=exclude_self, case_vec=case_vec, query_vec=query_vec,
        with_bound=True,
    )
    hits = hits.drop("route")
    return attach(hits, cases, cols=payload, max_hits=bound) if payload else hits


def filtered_top1(
    cases: DataFrame,
    queries: DataFrame,
    case_col: str,
    query_col: str,
    *,
    metric: str = "sql2",
    exclude_self: bool = False,
    payload: list[str] | None = None,
) -> DataFrame:
    """Top-1 among cases whose ``case_col`` equals the query's ``query_col``.
    A query with no matching case (or a null label) has no row."""
    hits, bound = nearest(
        cases, queries, [Route(1, case_col, query_col)], metric=metric, exclude_self=exclude_self, with_bound=True
    )
    hits = hits.drop("route")
    return attach(hits, cases, cols=payload, max_hits=bound) if payload else hits


def multiroute(
    cases: DataFrame,
    queries: DataFrame,
    *,
    routes: tuple[tuple[str, str], ...] = (("industry", "q_industry"), ("archetype", "q_archetype")),
    classified_col: str = "classified",
    fallback_k: int = 3,
    name_col: str = "company_name",
    metric: str = "sql2",
    exclude_self: bool = False,
    payload: list[str] | None = None,
) -> DataFrame:
    """Multi-route recall.

    Classified queries: the filtered top-1 of each route in order, then the
    global top-1; rows deduplicated by company name (first route wins, a
    missing name counts as ''), ordered by distance with route order breaking
    ties. Unclassified queries, and classified ones where every route came back
    empty, get the plain global top-``fallback_k`` (no dedupe).
    All routes are answered by one pass over the cases.
    Output: (query_id, rank, route, id, distance, fallback, name_col, payload...).
    """
    nr = len(routes)
    # Unclassified queries carry null labels so the filtered routes skip them.
    q = queries.select(
        "*",
        *[
            F.when(F.col(classified_col), F.col(qc)).alias(f"_rq{i}")
            for i, (_, qc) in enumerate(routes)
        ],
    )
    rts = [Route(1, cc, f"_rq{i}") for i, (cc, _) in enumerate(routes)] + [Route(fallback_k)]
    hits, bound = nearest(cases, q, rts, metric=metric, exclude_self=exclude_self, with_bound=True)
    cols = [name_col] + [c for c in (payload or []) if c != name_col]
    hits = attach(hits, cases, cols=cols, max_hits=bound)
    # one row per query: at most ``bound`` rows, broadcast when under the limit
    klass = q.select(F.col("query_id").cast(hits.schema["query_id"].dataType).alias("query_id"), F.coalesce(F.col(classified_col), F.lit(False)).alias("_cls"))
    if broadcastable(bound):
        klass = F.broadcast(klass)
    glob = nr + 1

    # Single pass over the hit list (the kNN result is consumed once):
    # classified -> the routed top-1 rows, deduplicated by name (first route
    # wins); unclassified -> the global top-k as is. A classified query whose
    # routes are all empty has an empty global route too, so its fallback
    # (global top-k) is empty as well and needs no branch of its own.
    h = hits.join(klass, "query_id")
    keep = (F.col("_cls") & ((F.col("route") <= nr) | (F.col("rank") == 1))) | (
        ~F.col("_cls") & (F.col("route") == glob)
    )
    key = F.when(F.col("_cls"), F.coalesce(F.col(name_col), F.lit(""))).otherwise(
        F.concat(F.lit("\u0000"), F.col("route").cast("string"), F.lit(":"), F.col("rank").cast("string"))
    )
    first = Window.partitionBy("query_id", "_key").orderBy("route")
    merged = (
        h.where(keep).withColumn("_key", key)
        .withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1)
        .withColumn("fallback", ~F.col("_cls"))
    )
    order = Window.partitionBy("query_id").orderBy("distance", "route", "id")
    return (
        merged.withColumn("rank", F.row_number().over(order).cast("long"))
        .select("query_id", "rank", "route", "id", "distance", "fallback", *cols)
    )


def refused(top1_distance: F.Column, threshold: float = GATE_THRESHOLD) -> F.Column:
    """The gate's decision: the best distance exceeds the threshold (equal passes)."""
    return top1_distance > F.lit(threshold)


def gate(results: DataFrame, threshold: float = GATE_THRESHOLD, message: str = REFUSAL_MESSAGE) -> DataFrame:
    """Per query: refuse when the rank-1 distance exceeds ``threshold`` (equal
    passes). Output (query_id, status, top1_distance, message)."""
    top1 = results.where(F.col("rank") == 1).select("query_id", F.col("distance").alias("top1_distance"))
    no = refused(F.col("top1_distance"), threshold)
    return top1.select(
        "query_id",
        F.when(no, F.lit("refused")).otherwise(F.lit("ok")).alias("status"),
        "top1_distance",
        F.when(no, F.lit(message)).alias("message"),
    )


def query_status(queries: DataFrame, hits: DataFrame, *, query_id: str = "query_id", query_vec: str = "embedding",
                 metric: str = "sql2") -> DataFrame:
    """One row per query: (query_id, status, reason). ``error`` for a vector that
    cannot be searched (see ``vector_status``) and for a query without hits
    ('no_case': no case of its vector length or label is left), else ``ok``."""
    found = hits.select(F.col("query_id").alias("_hit")).distinct()
    state = vector_status(query_vec, metric=metric)
    own = queries.select(F.col(query_id).cast(hits.schema["query_id"].dataType).alias("query_id"), state.alias("_state"))
    reason = F.when(F.col("_state") != "ok", F.col("_state")).when(F.col("_hit").isNull(), F.lit("no_case"))
    return own.join(found, F.col("query_id") == F.col("_hit"), "left").select(
        "query_id", F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"), reason.alias("reason"))


def matched_names(results: DataFrame, name_col: str = "company_name", missing: str = "N/A") -> DataFrame:
    """Per query, the matched names in rank order joined by ', '. Groups hold
    at most k rows per query."""
    return results.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", F.coalesce(F.col(name_col), F.lit(missing)).alias("n")))),
                lambda s: s["n"],
            ),
            ", ",
        ).alias("matched_names"),
        F.count("*").alias("n_matches"),
    )


def top1_enriched(
    cases: DataFrame,
    queries: DataFrame,
    records: DataFrame,
    *,
    record_key: str = "target_id",
    record_pos: str = "pos",
    meta_archetype: str = "archetype",
    outcome_col: str = "ultimate_outcome",
    metric: str = "sql2",
    exclude_self: bool = False,
) -> DataFrame:
    """Single best match with the query vector normalised first, enriched from
    a record table indexed by id (last duplicate wins): archetype prefers the
    case metadata, then the record, then ''; long fields default to ''."""
    q = queries.withColumn("embedding", normalise("embedding"))
    hits, bound = nearest(cases, q, [Route(1)], metric=metric, exclude_self=exclude_self, with_bound=True)
    hits = attach(hits.drop("route", "rank"), cases, cols=[meta_archetype, outcome_col], max_hits=bound)
    hits = hits.withColumnRenamed(meta_archetype, "_meta_arch")
    idx = records.groupBy(F.col(record_key).cast(hits.schema["id"].dataType).alias("id")).agg(
        F.max_by(F.struct("core_cognitive_bias", "fatal_action", "archetype"), F.col(record_pos)).alias("rec")
    )
    return hits.join(idx, "id", "left").select(
        "query_id",
        F.col("id").alias("target_id"),
        F.coalesce(F.col("_meta_arch"), F.col("rec.archetype"), F.lit("")).alias("archetype"),
        F.coalesce(F.col("rec.core_cognitive_bias"), F.lit("")).alias("core_cognitive_bias"),
        F.coalesce(F.col("rec.fatal_action"), F.lit("")).alias("fatal_action"),
        F.col(outcome_col).alias("outcome"),
        "distance",
    )
