"""Model-output normalisation: request texts out, response texts in.

Model calls are not Spark work; requests are rows of a table and responses
come back as a table ``(id, attempt, raw)``. Everything here is a Column
expression, an aggregate or a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.functions import jsonx
from precedent.functions.text import fill
from precedent.session import spread

PROFILE_FIELDS = ["archetype", "fatal_action", "trigger_condition", "ultimate_outcome"]
CLEANSE_FIELDS = ["industry", "failure_reasons", "archetype"]
MAX_ATTEMPTS = 3

# The profile written for a record whose attempts all failed
# (the archetype doubles as the failure marker in the run statistics), and the
# per-field defaults of the request texts and the merge.
FAILED_ARCHETYPE = "Analysis Failed"
FAILED_ACTION = "LLM processing failed after retries"
NOT_AVAILABLE = "N/A"
UNKNOWN = "Unknown"


# Texts of the requests: defaults in wording and layout of our own; both functions take others.
PROFILE_TEMPLATE = (
    "Write one JSON object with the keys archetype, fatal_action, trigger_condition and ultimate_outcome for this failure.\n"
    "* how it ended: {outcome}\n* what went wrong, as noted: {failure_reasons}\n* read at {source_url}\n"
    "* {company_name} worked in {industry} and had raised {funding_amount}\n"
)
CLEANSE_TEMPLATE = (
    'Keep the archetype "{archetype}". From the note below, work out an industry in a few words and the reasons of the '
    "failure in at most three sentences. Reply with a JSON object (keys archetype, failure_reasons, industry) and nothing "
    "else.\nNote on {company_name}: {description}\n"
)


def profile_prompt(df: DataFrame, out: str = "prompt", template: str = PROFILE_TEMPLATE) -> DataFrame:
    """Request text from the six raw-case fields; a missing field reads
    'Unknown' (name) or 'N/A' (others)."""
    names = ["company_name", "industry", "funding_amount", "failure_reasons", "outcome", "source_url"]
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN if c == "company_name" else NOT_AVAILABLE)) for c in names}
    return df.withColumn(out, fill(template, said))


def raw_description(fatal_action: str = "fatal_action", failure_reasons: str = "failure_reasons") -> F.Column:
    """First present of two fields, else ''."""
    return F.coalesce(F.col(fatal_action), F.col(failure_reasons), F.lit(""))


def cleanse_prompt(df: DataFrame, out: str = "prompt", template: str = CLEANSE_TEMPLATE) -> DataFrame:
    """Cleansing request from name, description and the archetype to keep."""
    said = {c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in ("company_name", "archetype")}
    return df.withColumn(out, fill(template, {**said, "description": raw_description()}))


def parse_strict(df: DataFrame, text_col: str = "raw", required: list[str] = PROFILE_FIELDS) -> DataFrame:
    """Adds ``parsed`` (struct of the required fields, null when no candidate
    gives an object with all of them) and ``valid``."""
    return spread(df).withColumn("parsed", jsonx.extract_object(F.col(text_col), required)).withColumn(
        "valid", F.col("parsed").isNotNull()
    )


def missing_fields(text_col: str, required: list[str] = PROFILE_FIELDS) -> F.Column:
    """Required keys absent from the whole-text object (sorted), null when the
    text is not one object."""
    m = jsonx.object_keys(jsonx.unfence_anchored(jsonx.strip(F.col(text_col))))
    req = F.array(*[F.lit(k) for k in sorted(required)])
    return F.when(m.isNotNull(), F.array_except(req, F.map_keys(m)))


def parse_lenient(df: DataFrame, text_col: str = "raw", fields: list[str] = CLEANSE_FIELDS) -> DataFrame:
    """Adds ``keys`` (map, for presence), ``values`` (struct) and ``is_object``."""
    p = jsonx.extract_lenient(F.col(text_col), fields)
    return (
        spread(df).withColumn("_lenient", p)
        .withColumn("keys", F.col("_lenient.keys"))
        .withColumn("values", F.col("_lenient.values"))
        .withColumn("is_object", F.col("keys").isNotNull())
        .drop("_lenient")
    )


def first_valid(parsed: DataFrame, id_col: str, attempt_col: str = "attempt", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per id, the parsed value of the earliest valid attempt within
    ``max_attempts``. Aggregated in each task before the shuffle, so an id with
    very many attempts is no hot spot."""
    # The condition lives in the ordering (min_by skips null orderings), not
    # in a filter, which the optimizer would push below the parse and so
    # evaluate the parse twice.
    order = F.when(F.col("parsed").isNotNull() & (F.col(attempt_col) <= max_attempts), F.col(attempt_col))
    agg = parsed.groupBy(id_col).agg(
        F.min(order).alias("attempt"),
        F.min_by("parsed", order).alias("parsed"),
    )
    return agg.where(F.col("attempt").isNotNull())


def profile_records(records: DataFrame, best: DataFrame, id_col: str) -> DataFrame:
    """Keep-all policy: every record gets a profile; a record with no valid
    attempt gets the fixed failure profile and its own outcome text."""
    j = records.join(best, id_col, "left")
    ok = F.col("parsed").isNotNull()
    return j.select(
        id_col,
        F.coalesce(F.col("company_name"), F.lit(UNKNOWN)).alias("company_name"),
        F.coalesce(F.col("funding_amount"), F.lit(NOT_AVAILABLE)).alias("funding_amount"),
        F.when(ok, F.col("parsed.archetype")).otherwise(F.lit(FAILED_ARCHETYPE)).alias("archetype"),
        F.when(ok, F.col("parsed.fatal_action")).otherwise(F.lit(FAILED_ACTION)).alias("fatal_action"),
        F.when(ok, F.col("parsed.trigger_condition")).otherwise(F.lit(NOT_AVAILABLE)).alias("trigger_condition"),
        F.when(ok, F.col("parsed.ultimate_outcome"))
        .otherwise(F.coalesce(F.col("outcome"), F.lit(NOT_AVAILABLE)))
        .alias("ultimate_outcome"),
        ok.alias("success"),
    )


def _get(keys: F.Column, values: F.Column, k: str, default: F.Column) -> F.Column:
    """dict.get(k, default): the default only when the key is absent."""
    return F.when(F.map_contains_key(keys, F.lit(k)), values[k]).otherwise(default)


def cleanse_records(
    records: DataFrame,
    parsed: DataFrame,
    id_col: str,
    funding_lookup: DataFrame,
    archetype_lookup: DataFrame,
) -> DataFrame:
    """Drop policy: records whose response is not one JSON object are dropped;
    the rest are merged field by field with missing-key defaults. Lookups are
    (key, value) tables keyed by company name."""
    ok = parsed.where(F.col("is_object")).select(id_col, "keys", "values")
    j = records.join(ok, id_col, "inner")
    fl = funding_lookup.select(F.col("key").alias("_fk"), F.col("value").alias("_fund"))
    al = archetype_lookup.select(F.col("key").alias("_ak"), F.col("value").alias("_arch"))
    j = j.join(fl, F.col("company_name") == F.col("_fk"), "left").join(al, F.col("company_name") == F.col("_ak"), "left")
    original_arch = F.coalesce(F.col("archetype"), F.lit(UNKNOWN))
    return j.select(
        id_col,
        "company_name",
        _get(F.col("keys"), F.col("values"), "industry", F.lit(UNKNOWN)).alias("industry"),
        _get(F.col("keys"), F.col("values"), "failure_reasons", raw_description()).alias("failure_reasons"),
        F.coalesce(F.col("_fund"), F.lit(UNKNOWN)).alias("funding_amount"),
        _get(F.col("keys"), F.col("values"), "archetype", F.coalesce(F.col("_arch"), original_arch)).alias("archetype"),
    )


def run_stats(profiles: DataFrame) -> DataFrame:
    """total / success / failed / saved of a keep-all run."""
    return profiles.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("archetype").eqNullSafe(F.lit(FAILED_ARCHETYPE))).alias("success"),
        F.count_if(F.col("archetype") == F.lit(FAILED_ARCHETYPE)).alias("failed"),
        F.count(F.lit(1)).alias("saved"),
    )


def parse_classification(df: DataFrame, text_col: str, fields: tuple[str, ...] = ("industry", "archetype")) -> DataFrame:
    """Classification answer: the trimmed text must be one JSON object (no
    fence stripping, no extraction); values are not checked against any
    domain. Adds ``classified`` and one column per field: the value, '' when
    the key is absent, null when the answer is not an object."""
    cur = df.withColumn("_cls", jsonx.object_keys(jsonx.strip(F.col(text_col))))
    cur = cur.withColumn("_val", jsonx.object_values(jsonx.strip(F.col(text_col)), list(fields)))
    out = cur.withColumn("classified", F.col("_cls").isNotNull())
    for f in fields:
        out = out.withColumn(
            f, F.when(F.col("classified"), _get(F.col("_cls"), F.col("_val"), f, F.lit("")))
        )
    return out.drop("_cls", "_val")
