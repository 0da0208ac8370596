"""Model-output normalisation queries (M1-M14, M17).

Responses are derived from ``events``: every event is one model answer.
Profile path: record id = event_id div 4, attempt = event_id % 4 + 1 (four
attempts per record, the fourth beyond the retry limit); the answer text is
the event rendered as a profile object and then damaged in one of ten ways
chosen by (7 * user_id + event_id) % 10. Cleansing path: one answer per
event, eight shapes chosen by (user_id + 3 * event_id) % 8.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from precedent.operators import enrich as J
from precedent.operators import responses as M
from precedent.plans.catalog import register
from precedent.plans.tables import classification_answer, read, sql_text


def _q(s: str) -> F.Column:
    return F.lit(s)


def profile_responses(spark, d):
    e = read(spark, d, "events")
    a = F.concat(_q('"archetype": "'), F.col("event_type"), _q('"'))
    b = F.concat(_q('"fatal_action": "spent '), F.format_string("%.2f", F.col("value")), _q('"'))
    c = F.concat(_q('"trigger_condition": '), F.col("props"))
    dd = F.concat(_q('"ultimate_outcome": "user '), F.col("user_id").cast("string"), _q('"'))
    full = F.concat(_q("{"), a, _q(", "), b, _q(", "), c, _q(", "), dd, _q("}"))
    v = (F.col("user_id") * 7 + F.col("event_id")) % 10
    raw = (
        F.when(v == 0, full)
        .when(v == 1, F.concat(_q("```json\n"), full, _q("\n```")))
        .when(v == 2, F.concat(_q("```\n"), full, _q("\n```")))
        .when(v == 3, F.concat(_q("Here is the profile: "), full, _q(" Hope it helps.")))
        .when(v == 4, F.concat(_q("{"), a, _q(", "), b, _q(", "), c, _q(", "), dd, _q(",}")))
        .when(v == 5, F.concat(_q("{"), a, _q(", "), b, _q(", "), c, _q("}")))
        .when(v == 6, F.replace(full, _q('"'), _q("'")))
        .when(v == 7, F.concat(_q("{"), a, _q(", "), b))
        .when(v == 8, _q("   "))
    )
    return e.select(
        "event_id",
        F.expr("event_id div 4").alias("rid"),
        (F.col("event_id") % 4 + 1).cast("int").alias("attempt"),
        raw.alias("raw"),
        "user_id", "event_type", "value",
    )


PROFILE_SQL = """
WITH ev AS (
  SELECT *, '"archetype": "' || event_type || '"' AS a,
         '"fatal_action": "spent ' || printf('%.2f', value) || '"' AS b,
         '"trigger_condition": ' || props AS c,
         '"ultimate_outcome": "user ' || CAST(user_id AS VARCHAR) || '"' AS dd,
         (user_id * 7 + event_id) % 10 AS v
  FROM events),
resp AS (
  SELECT event_id, event_id // 4 AS rid, CAST(event_id % 4 + 1 AS INTEGER) AS attempt, user_id, event_type, value,
    CASE v WHEN 0 THEN '{' || a || ', ' || b || ', ' || c || ', ' || dd || '}'
           WHEN 1 THEN '```json' || chr(10) || '{' || a || ', ' || b || ', ' || c || ', ' || dd || '}' || chr(10) || '```'
           WHEN 2 THEN '```' || chr(10) || '{' || a || ', ' || b || ', ' || c || ', ' || dd || '}' || chr(10) || '```'
           WHEN 3 THEN 'Here is the profile: {' || a || ', ' || b || ', ' || c || ', ' || dd || '} Hope it helps.'
           WHEN 4 THEN '{' || a || ', ' || b || ', ' || c || ', ' || dd || ',}'
           WHEN 5 THEN '{' || a || ', ' || b || ', ' || c || '}'
           WHEN 6 THEN replace('{' || a || ', ' || b || ', ' || c || ', ' || dd || '}', '"', '''')
           WHEN 7 THEN '{' || a || ', ' || b
           WHEN 8 THEN '   ' END AS raw
  FROM ev),
st AS (
  SELECT *, CASE WHEN raw IS NOT NULL AND regexp_replace(raw, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') <> ''
                 THEN regexp_replace(raw, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') END AS t
  FROM resp),
cand AS (
  SELECT *, [t, regexp_extract(t, '\\{[^{}]*\\}', 0), regexp_extract(t, '(?s)\\{.*\\}', 0)] AS cs FROM st),
unf AS (
  SELECT *, list_transform(cs, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
              '^```(json)?\\s*', ''), '\\s*```$', ''), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g'),
              ',\\s*([}\\]])', '\\1', 'g')) AS us
  FROM cand),
okc AS (
  SELECT *, list_filter(us, lambda u: CASE WHEN starts_with(u, '{') AND ends_with(u, '}') AND json_valid(u)
            THEN json_exists(u, '$.archetype') AND json_exists(u, '$.fatal_action')
                 AND json_exists(u, '$.trigger_condition') AND json_exists(u, '$.ultimate_outcome')
            ELSE false END) AS goods
  FROM unf),
parsed AS (
  SELECT *, CASE WHEN t IS NOT NULL AND len(goods) > 0 THEN goods[1] END AS g FROM okc),
vals AS (
  SELECT event_id, rid, attempt, raw, us[1] AS whole, g IS NOT NULL AS valid,
         json_extract_string(g, '$.archetype') AS archetype, json_extract_string(g, '$.fatal_action') AS fatal_action,
         json_extract_string(g, '$.trigger_condition') AS trigger_condition,
         json_extract_string(g, '$.ultimate_outcome') AS ultimate_outcome
  FROM parsed),
best AS (
  SELECT rid, min(attempt) AS attempt, arg_min(archetype, attempt) AS archetype, arg_min(fatal_action, attempt) AS fatal_action,
         arg_min(trigger_condition, attempt) AS trigger_condition, arg_min(ultimate_outcome, attempt) AS ultimate_outcome
  FROM vals WHERE valid AND attempt <= 3 GROUP BY rid),
rec AS (
  SELECT rid, 'co' || CAST(rid AS VARCHAR) AS company_name,
         CASE WHEN arg_min(value, event_id) > 50 THEN '$' || printf('%.2f', arg_min(value, event_id)) || 'M' END AS funding_amount,
         'closed after ' || arg_min(event_type, event_id) AS outcome
  FROM events_r GROUP BY rid)
"""
PROFILE_SQL = PROFILE_SQL.replace("FROM events_r", "FROM (SELECT *, event_id // 4 AS rid FROM events)")


def profile_records_raw(spark, d):
    """One raw case per record id: fields of its first event."""
    e = read(spark, d, "events").withColumn("rid", F.expr("event_id div 4"))
    first = e.groupBy("rid").agg(F.min_by(F.struct("value", "event_type"), F.col("event_id")).alias("f"))
    return first.select(
        "rid",
        F.concat(_q("co"), F.col("rid").cast("string")).alias("company_name"),
        F.lit(None).cast("string").alias("industry"),
        F.when(F.col("f.value") > 50, F.concat(_q("$"), F.format_string("%.2f", F.col("f.value")), _q("M"))).alias(
            "funding_amount"
        ),
        F.lit(None).cast("string").alias("failure_reasons"),
        F.concat(_q("closed after "), F.col("f.event_type")).alias("outcome"),
        F.lit(None).cast("string").alias("source_url"),
    )


# ---------------------------------------------------------------- M4a, M5, M6, M7, M9
@register(
    "response_extract_json",
    PROFILE_SQL + "SELECT event_id, rid, attempt, valid, archetype, fatal_action, trigger_condition, ultimate_outcome FROM vals",
)
def response_extract_json(spark, d):
    p = M.parse_strict(profile_responses(spark, d))
    return p.select(
        "event_id", "rid", "attempt", "valid",
        *[F.col(f"parsed.{f}").alias(f) for f in M.PROFILE_FIELDS],
    )


# ---------------------------------------------------------------- M8
@register(
    "response_required_fields",
    PROFILE_SQL + """
SELECT event_id,
       CASE WHEN starts_with(whole, '{') AND ends_with(whole, '}') AND json_valid(whole)
            THEN array_to_string(list_filter(['archetype', 'fatal_action', 'trigger_condition', 'ultimate_outcome'],
                                             lambda k: NOT list_contains(json_keys(whole), k)), ',') END AS missing_fields
FROM vals""",
)
def response_required_fields(spark, d):
    r = profile_responses(spark, d)
    return r.select("event_id", F.array_join(M.missing_fields("raw"), ",").alias("missing_fields"))


# ---------------------------------------------------------------- M10
@register(
    "response_first_valid",
    PROFILE_SQL + "SELECT rid, attempt, archetype, fatal_action, trigger_condition, ultimate_outcome FROM best",
)
def response_first_valid(spark, d):
    b = M.first_valid(M.parse_strict(profile_responses(spark, d)), "rid")
    return b.select("rid", "attempt", *[F.col(f"parsed.{f}").alias(f) for f in M.PROFILE_FIELDS])


def _profiles(spark, d):
    best = M.first_valid(M.parse_strict(profile_responses(spark, d)), "rid")
    return M.profile_records(profile_records_raw(spark, d), best, "rid")


PROFILES_SQL = PROFILE_SQL + """,
prof AS (
  SELECT r.rid, r.company_name, coalesce(r.funding_amount, 'N/A') AS funding_amount,
         CASE WHEN b.rid IS NOT NULL THEN b.archetype ELSE 'Analysis Failed' END AS archetype,
         CASE WHEN b.rid IS NOT NULL THEN b.fatal_action ELSE 'LLM processing failed after retries' END AS fatal_action,
         CASE WHEN b.rid IS NOT NULL THEN b.trigger_condition ELSE 'N/A' END AS trigger_condition,
         CASE WHEN b.rid IS NOT NULL THEN b.ultimate_outcome ELSE coalesce(r.outcome, 'N/A') END AS ultimate_outcome,
         b.rid IS NOT NULL AS success
  FROM rec r LEFT JOIN best b ON b.rid = r.rid)
"""


# ---------------------------------------------------------------- M11, M13
@register(
    "response_fallback_default",
    PROFILES_SQL + "SELECT * FROM prof",
)
def response_fallback_default(spark, d):
    return _profiles(spark, d)


# ---------------------------------------------------------------- M17
@register(
    "response_run_stats",
    PROFILES_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE archetype IS DISTINCT FROM 'Analysis Failed') AS success,
       count(*) FILTER (WHERE archetype = 'Analysis Failed') AS failed, count(*) AS saved FROM prof""",
)
def response_run_stats(spark, d):
    return M.run_stats(_profiles(spark, d))


# ---------------------------------------------------------------- cleansing path
def cleanse_inputs(spark, d):
    e = read(spark, d, "events")
    name = F.concat(_q("co"), F.col("user_id").cast("string"))
    recs = e.select(
        "event_id",
        name.alias("company_name"),
        F.when(F.col("value") > 50, F.concat(_q("spent "), F.format_string("%.2f", F.col("value")))).alias("fatal_action"),
        F.concat(_q("event "), F.col("event_type")).alias("failure_reasons"),
        F.when(F.col("user_id") % 5 != 0, F.concat(_q("orig"), (F.col("user_id") % 3).cast("string"))).alias("archetype"),
    )
    ind = F.concat(_q('"industry": "'), F.col("event_type"), _q('"'))
    rea = F.concat(_q('"failure_reasons": "user '), F.col("user_id").cast("string"), _q(' churned."'))
    arc = F.concat(_q('"archetype": "arc'), (F.col("user_id") % 8).cast("string"), _q('"'))
    obj = F.concat(_q("{"), ind, _q(", "), rea, _q(", "), arc, _q("}"))
    v = (F.col("user_id") + F.col("event_id") * 3) % 8
    raw = (
        F.when(v == 0, obj)
        .when(v == 1, F.concat(_q("```json\n"), obj, _q("\n```")))
        .when(v == 2, F.concat(_q("{"), rea, _q(", "), arc, _q("}")))
        .when(v == 3, F.concat(_q("{"), ind, _q(", "), rea, _q("}")))
        .when(v == 4, F.concat(_q("["), obj, _q("]")))
        .when(v == 5, F.col("user_id").cast("string"))
        .when(v == 6, F.concat(_q("Sure! "), obj))
        .otherwise(F.concat(_q("{"), ind, _q(', "failure_reasons": null, '), arc, _q("}")))
    )
    resp = e.select("event_id", raw.alias("raw"))
    funding = J.build_lookup(
        e.select(name.alias("k"), F.when(F.col("event_type") == "purchase",
                                         F.concat(_q("$"), F.format_string("%.2f", F.col("value")), _q("M"))).alias("v"),
                 "event_id"),
        "k", "v", "event_id",
    )
    arch = J.build_lookup(
        e.select(name.alias("k"), F.when(F.col("event_type") == "signup",
                                         F.concat(_q("arc"), (F.col("event_id") % 8).cast("string"))).alias("v"),
                 "event_id"),
        "k", "v", "event_id",
    )
    return recs, resp, funding, arch


CLEANSE_SQL = """
WITH recs AS (
  SELECT event_id, 'co' || CAST(user_id AS VARCHAR) AS company_name,
         CASE WHEN value > 50 THEN 'spent ' || printf('%.2f', value) END AS fatal_action,
         'event ' || event_type AS failure_reasons,
         CASE WHEN user_id % 5 <> 0 THEN 'orig' || CAST(user_id % 3 AS VARCHAR) END AS archetype,
         '"industry": "' || event_type || '"' AS ind,
         '"failure_reasons": "user ' || CAST(user_id AS VARCHAR) || ' churned."' AS rea,
         '"archetype": "arc' || CAST(user_id % 8 AS VARCHAR) || '"' AS arc,
         (user_id + event_id * 3) % 8 AS v, user_id
  FROM events),
resp AS (
  SELECT *, CASE v WHEN 0 THEN '{' || ind || ', ' || rea || ', ' || arc || '}'
                   WHEN 1 THEN '```json' || chr(10) || '{' || ind || ', ' || rea || ', ' || arc || '}' || chr(10) || '```'
                   WHEN 2 THEN '{' || rea || ', ' || arc || '}'
                   WHEN 3 THEN '{' || ind || ', ' || rea || '}'
                   WHEN 4 THEN '[{' || ind || ', ' || rea || ', ' || arc || '}]'
                   WHEN 5 THEN CAST(user_id AS VARCHAR)
                   WHEN 6 THEN 'Sure! {' || ind || ', ' || rea || ', ' || arc || '}'
                   ELSE '{' || ind || ', "failure_reasons": null, ' || arc || '}' END AS raw
  FROM recs),
st AS (SELECT *, regexp_replace(raw, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS t0 FROM resp),
unf AS (
  SELECT *, regexp_replace(CASE WHEN starts_with(t0, '```')
              THEN array_to_string(list_filter(string_split(t0, chr(10)),
                     lambda l: NOT starts_with(regexp_replace(l, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g'), '```')), chr(10))
              ELSE t0 END, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS u
  FROM st),
obj AS (SELECT *, starts_with(u, '{') AND ends_with(u, '}') AND json_valid(u) AS is_object FROM unf),
flk AS (SELECT 'co' || CAST(user_id AS VARCHAR) AS key, arg_max('$' || printf('%.2f', value) || 'M', event_id) AS value
        FROM events WHERE event_type = 'purchase' GROUP BY user_id),
alk AS (SELECT 'co' || CAST(user_id AS VARCHAR) AS key, arg_max('arc' || CAST(event_id % 8 AS VARCHAR), event_id) AS value
        FROM events WHERE event_type = 'signup' GROUP BY user_id),
merged AS (
  SELECT o.event_id, o.company_name,
         CASE WHEN json_exists(o.u, '$.industry') THEN json_extract_string(o.u, '$.industry') ELSE 'Unknown' END AS industry,
         CASE WHEN json_exists(o.u, '$.failure_reasons') THEN json_extract_string(o.u, '$.failure_reasons')
              ELSE coalesce(o.fatal_action, o.failure_reasons, '') END AS failure_reasons,
         coalesce(f.value, 'Unknown') AS funding_amount,
         CASE WHEN json_exists(o.u, '$.archetype') THEN json_extract_string(o.u, '$.archetype')
              ELSE coalesce(a.value, coalesce(o.archetype, 'Unknown')) END AS archetype
  FROM obj o LEFT JOIN flk f ON f.key = o.company_name LEFT JOIN alk a ON a.key = o.company_name
  WHERE o.is_object)
"""


# ---------------------------------------------------------------- M4b
@register(
    "response_extract_lenient",
    CLEANSE_SQL + """
SELECT event_id, is_object,
       CASE WHEN is_object THEN json_extract_string(u, '$.industry') END AS industry,
       CASE WHEN is_object THEN json_extract_string(u, '$.failure_reasons') END AS failure_reasons,
       CASE WHEN is_object THEN json_extract_string(u, '$.archetype') END AS archetype
FROM obj""",
)
def response_extract_lenient(spark, d):
    _, resp, _, _ = cleanse_inputs(spark, d)
    p = M.parse_lenient(resp)
    return p.select("event_id", "is_object", *[F.col(f"values.{f}").alias(f) for f in M.CLEANSE_FIELDS])


# ---------------------------------------------------------------- M12
@register(
    "response_fallback_drop",
    CLEANSE_SQL + "SELECT event_id, company_name FROM merged",
)
def response_fallback_drop(spark, d):
    recs, resp, fl, al = cleanse_inputs(spark, d)
    return M.cleanse_records(recs, M.parse_lenient(resp), "event_id", fl, al).select("event_id", "company_name")


# ---------------------------------------------------------------- M13, M14
@register("response_merge", CLEANSE_SQL + "SELECT * FROM merged")
def response_merge(spark, d):
    recs, resp, fl, al = cleanse_inputs(spark, d)
    return M.cleanse_records(recs, M.parse_lenient(resp), "event_id", fl, al)


# ---------------------------------------------------------------- M1
@register(
    "request_profile_prompt",
    "SELECT s_suppkey, " + sql_text(
        M.PROFILE_TEMPLATE, company_name="coalesce(s_name, 'Unknown')", industry="coalesce(n_name, 'N/A')",
        funding_amount="coalesce(CASE WHEN s_acctbal >= 0 THEN '$' || printf('%.2f', s_acctbal) END, 'N/A')",
        failure_reasons="CASE WHEN s_suppkey % 3 = 0 THEN 'N/A' ELSE 'balance of ' || s_name END",
        outcome="'nation ' || CAST(s_nationkey AS VARCHAR)",
        source_url="CASE WHEN s_suppkey % 2 = 0 THEN 'N/A' ELSE 'https://s.example/' || CAST(s_suppkey AS VARCHAR) END") + """ AS prompt
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
)
def request_profile_prompt(spark, d):
    s = read(spark, d, "supplier")
    n = read(spark, d, "nation")
    recs = s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        "s_suppkey",
        F.col("s_name").alias("company_name"),
        F.col("n_name").alias("industry"),
        F.when(F.col("s_acctbal") >= 0, F.concat(_q("$"), F.format_string("%.2f", F.col("s_acctbal")))).alias(
            "funding_amount"
        ),
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(_q("balance of "), F.col("s_name"))).alias("failure_reasons"),
        F.concat(_q("nation "), F.col("s_nationkey").cast("string")).alias("outcome"),
        F.when(F.col("s_suppkey") % 2 != 0, F.concat(_q("https://s.example/"), F.col("s_suppkey").cast("string"))).alias("source_url"),
    )
    return M.profile_prompt(recs).select("s_suppkey", "prompt")


# ---------------------------------------------------------------- M2, M3
@register(
    "request_cleanse_prompt",
    "SELECT p_partkey, " + sql_text(
        M.CLEANSE_TEMPLATE, company_name="p_name", archetype="coalesce(CASE WHEN p_size > 10 THEN p_brand END, 'Unknown')",
        description="coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, CASE WHEN p_size % 3 = 0 THEN p_brand END, '')") + """ AS prompt
FROM part""",
)
def request_cleanse_prompt(spark, d):
    p = read(spark, d, "part")
    recs = p.select(
        "p_partkey",
        F.col("p_name").alias("company_name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("fatal_action"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("failure_reasons"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("archetype"),
    )
    return M.cleanse_prompt(recs).select("p_partkey", "prompt")


# ---------------------------------------------------------------- M15
def classification_answers(spark, d):
    return read(spark, d, "embeddings").select(
        F.col("vec_id").alias("query_id"), classification_answer().alias("answer")
    )


@register(
    "response_classification",
    """
WITH a AS (
  SELECT vec_id AS query_id,
    CASE WHEN vec_id % 3 = 0 THEN 'I cannot tell.'
         WHEN vec_id % 11 = 0 THEN '```json' || chr(10) || '{"industry": "ind' || CAST(label AS VARCHAR) || '", "archetype": "arc'
                                   || CAST(label % 8 AS VARCHAR) || '"}' || chr(10) || '```'
         WHEN vec_id % 7 = 0 THEN '{"industry": "ind_none", "archetype": "arc' || CAST(label % 8 AS VARCHAR) || '"}'
         WHEN vec_id % 13 = 0 THEN '{"archetype": "arc' || CAST(label % 8 AS VARCHAR) || '"}'
         ELSE '  {"industry": "ind' || CAST(label AS VARCHAR) || '", "archetype": "arc' || CAST(label % 8 AS VARCHAR) || '"}' || chr(10)
    END AS answer
  FROM embeddings),
t AS (SELECT query_id, regexp_replace(answer, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS t FROM a),
o AS (SELECT query_id, t, starts_with(t, '{') AND ends_with(t, '}') AND json_valid(t) AS classified FROM t)
SELECT query_id, classified,
       CASE WHEN classified THEN CASE WHEN json_exists(t, '$.industry') THEN json_extract_string(t, '$.industry') ELSE '' END END AS industry,
       CASE WHEN classified THEN CASE WHEN json_exists(t, '$.archetype') THEN json_extract_string(t, '$.archetype') ELSE '' END END AS archetype
FROM o""",
)
def response_classification(spark, d):
    return M.parse_classification(classification_answers(spark, d), "answer").select(
        "query_id", "classified", "industry", "archetype"
    )
