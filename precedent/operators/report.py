"""Reports over retrieval results: prompt messages, single-match prompt, top-1
summary, nested matched cases, match percent / threat band, display tags and
text lines.

Results are long form ``(query_id, rank, ...)`` with at most k rows per
query, so every per-query ``collect_list`` here holds at most k elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.functions.text import between_markers, fill, nonblank_lines, pad2, subject_tag

# Document markers written by operators.documents.build_document
REASONS_START = "Reasons: "
REASONS_END = ". Archetype:"

# Texts of the prompts: defaults in wording and layout of our own; every function takes others.
# Places of CASE_TEMPLATE: rank, company_name, funding_amount, archetype, industry, document;
# of USER_TEMPLATE: request, cases; of MATCH_TEMPLATE: the columns single_match_prompt reads.
SYSTEM_PROMPT = (
    "You review new ventures against documented failures. Cite the cases given, "
    "compare them with the venture point by point and end with a short verdict."
)
CASE_TEMPLATE = "({rank}) {archetype}\n{document}\nVenture: {company_name}; capital raised: {funding_amount}"
CASE_SEPARATOR = "\n~~~\n"
USER_TEMPLATE = "Proposal under review:\n{request}\n\nFailures that resemble it, nearest first:\n{cases}\n"
MATCH_TEMPLATE = (
    "A past failure ended like this: {outcome}\nIts turning point was: {fatal_action}\n"
    "Reviewers filed it as number {target_id} under {archetype}, with the bias {core_cognitive_bias}.\n"
    "Does the following proposal repeat it? Answer in 200 words or fewer.\n\n{query_text}"
)
MATCH_FIELDS = ["query_text", "target_id", "archetype", "core_cognitive_bias", "fatal_action", "outcome"]


def _in_rank_order(items: F.Column) -> F.Column:
    """Elements ``v`` of structs (rank, v) collected per query, by rank."""
    return F.transform(F.array_sort(F.collect_list(items)), lambda s: s["v"])


def _case_text(case_template: str, separator: str) -> F.Column:
    """Aggregate: the case blocks of a query in rank order, as one text."""
    fields = {c: F.col(c) for c in ("rank", "company_name", "funding_amount", "archetype", "industry", "document")}
    return F.array_join(_in_rank_order(F.struct("rank", fill(case_template, fields).alias("v"))), separator)


def _matched() -> F.Column:
    """Aggregate: the matches of a query in rank order."""
    match = F.struct(
        F.coalesce("company_name", F.lit("Unknown")).alias("company_name"),
        F.coalesce("archetype", F.lit("Unknown")).alias("archetype"),
        F.coalesce("industry", F.lit("Unknown")).alias("industry"),
        F.round("distance", 4).alias("distance"),
        between_markers(F.col("document"), REASONS_START, REASONS_END).alias("failure_reasons"),
    )
    return _in_rank_order(F.struct("rank", match.alias("v")))


def _summary_columns() -> list[F.Column]:
    reasons = between_markers(F.col("document"), REASONS_START, REASONS_END)
    return [
        F.coalesce("company_name", F.lit("Unknown")).alias("target_id"),
        F.coalesce("archetype", F.lit("Unknown")).alias("archetype"),
        F.concat(F.lit("Raised "), F.coalesce("funding_amount", F.lit("Unknown")), F.lit(", then failed: "), reasons).alias("outcome"),
        F.round("distance", 4).alias("distance"),
    ]


def user_message(request: F.Column, case_text: F.Column, user_template: str = USER_TEMPLATE) -> F.Column:
    """The user message of a request over the case blocks found for it."""
    return fill(user_template, {"request": request, "cases": case_text})


def chat(user: F.Column, system_prompt: str = SYSTEM_PROMPT) -> F.Column:
    """The system and the user message: array<struct<role, content>>."""
    said = [(F.lit("system"), F.lit(system_prompt)), (F.lit("user"), user)]
    return F.array(*[F.struct(role.alias("role"), text.alias("content")) for role, text in said])


def prompt_messages(
    results: DataFrame,
    queries: DataFrame,
    *,
    text_col: str = "query_text",
    system_prompt: str = SYSTEM_PROMPT,
    case_template: str = CASE_TEMPLATE,
    separator: str = CASE_SEPARATOR,
    user_template: str = USER_TEMPLATE,
) -> DataFrame:
    """Per query: the case blocks in rank order and the query text, put
    together by the templates. Output (query_id, user_message,
    messages array<struct<role,content>>)."""
    per_q = results.groupBy("query_id").agg(_case_text(case_template, separator).alias("_cases"))
    user = user_message(F.col(text_col), F.col("_cases"), user_template)
    return per_q.join(queries.select("query_id", text_col), "query_id").select(
        "query_id", user.alias("user_message"), chat(user, system_prompt).alias("messages"))


def single_match_prompt(df: DataFrame, template: str = MATCH_TEMPLATE) -> DataFrame:
    """Prompt for the older single-match path from six fields."""
    return df.select("query_id", fill(template, {c: F.col(c) for c in MATCH_FIELDS}).alias("prompt"))


def summary(results: DataFrame) -> DataFrame:
    """Top-1 fields per query; missing metadata defaults to 'Unknown'."""
    return results.where(F.col("rank") == 1).select("query_id", *_summary_columns())


def matched_cases(results: DataFrame) -> DataFrame:
    """Nested matches per query in rank order:
    array<struct<company_name, archetype, industry, distance, failure_reasons>>."""
    return results.groupBy("query_id").agg(_matched().alias("matched_cases"))


def sheet(results: DataFrame, *, case_template: str = CASE_TEMPLATE, separator: str = CASE_SEPARATOR) -> DataFrame:
    """All that a report says of a query, from one pass over the results (a
    search is evaluated once): (query_id, target_id, archetype, outcome,
    distance, top1_distance unrounded, match_percent, threat, matched_cases,
    case_text)."""
    top = F.struct(*_summary_columns(), F.col("distance").alias("top1_distance"),
                   match_percent("distance").alias("match_percent"), threat_level("distance").alias("threat"))
    return results.groupBy("query_id").agg(
        F.min_by(top, "rank").alias("_top"), _matched().alias("matched_cases"), _case_text(case_template, separator).alias("case_text"),
    ).select("query_id", "_top.*", "matched_cases", "case_text")


def match_percent(distance) -> F.Column:
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor((F.lit(1.0) - d) * 100 + 0.5))).cast("long")


def threat_level(distance, critical: float = 0.5, high: float = 0.8) -> F.Column:
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.when(d < critical, F.lit("CRITICAL")).when(d < high, F.lit("HIGH")).otherwise(F.lit("MODERATE"))


def threat(results: DataFrame) -> DataFrame:
    """Per result row: match percent and threat band of its distance."""
    return results.select(
        "query_id", "rank", F.round("distance", 4).alias("distance"),
        match_percent("distance").alias("match_percent"), threat_level("distance").alias("threat"),
    )


def tags(results: DataFrame) -> DataFrame:
    return results.select(
        "query_id", "rank",
        subject_tag(F.coalesce("company_name", F.lit(""))).alias("subject_tag"),
        F.concat(F.lit("Case_"), pad2(F.col("rank"))).alias("card_label"),
    )


def lines(df: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """Non-blank lines of a text column, one row per line with its position."""
    return df.select(*key_cols, F.posexplode(nonblank_lines(F.col(text_col))).alias("line_no", "line"))
