import pytest
from pyspark.sql import functions as F

from precedent.operators import responses as M

REQ = ["a", "b"]
CASES = [
    ("clean", '{"a": "1", "b": "2"}', ("1", "2")),
    ("fenced", '```\n{"a": "1", "b": "2"}\n```', ("1", "2")),
    ("fenced_lang", '```json\n{"a":"1","b":"2"}\n```', ("1", "2")),
    ("prose", 'Sure: {"a":"1","b":"2"} thanks', ("1", "2")),
    ("trailing_comma", '{"a":"1","b":"2",}', ("1", "2")),
    ("nested", '{"a": {"x": 1}, "b": "2"}', ('{"x":1}', "2")),
    ("nested_in_prose", 'x {"a": {"k": 1}, "b": "2"} y', ('{"k":1}', "2")),
    ("missing", '{"a":"1"}', None),
    ("null_field", '{"a": null, "b": "2"}', (None, "2")),
    ("extra", '{"a":"1","b":"2","c":"3"}', ("1", "2")),
    ("duplicate_key", '{"a":"1","a":"9","b":"2"}', ("9", "2")),
    ("single_quotes", "{'a':'1','b':'2'}", None),
    ("trailing_text", '{"a":"1","b":"2"} trailing', ("1", "2")),
    ("two_objects", '{"a":"1","b":"2"} {"a":"3","b":"4"}', ("1", "2")),
    ("array", '[{"a":"1","b":"2"}]', ("1", "2")),
    ("scalar", "42", None),
    ("blank", "   ", None),
    ("null", None, None),
]


def test_strict_extraction(spark):
    df = spark.createDataFrame([(n, t) for n, t, _ in CASES], "name string, raw string")
    got = {r.name: (None if r.parsed is None else (r.parsed.a, r.parsed.b))
           for r in M.parse_strict(df, "raw", REQ).collect()}
    assert got == {n: e for n, _, e in CASES}


def test_missing_fields(spark):
    df = spark.createDataFrame([("x", '{"b": 1}'), ("y", "nope")], "name string, raw string")
    got = {r.name: r.m for r in df.select("name", M.missing_fields("raw", REQ).alias("m")).collect()}
    assert got == {"x": ["a"], "y": None}


def test_lenient_extraction(spark):
    rows = [("fence", '```json\n{"industry":"x"}\n```'), ("list", "[1,2]"), ("scalar", "42"),
            ("prose", 'Sure {"industry":"x"}'), ("tail", '{"industry":"x"} tail'), ("obj", '{"industry": null}')]
    df = spark.createDataFrame(rows, "name string, raw string")
    got = {r.name: r.is_object for r in M.parse_lenient(df, "raw", ["industry"]).collect()}
    assert got == {"fence": True, "list": False, "scalar": False, "prose": False, "tail": False, "obj": True}


def test_first_valid_attempt_limit(spark):
    good, bad = '{"a":"g","b":"h"}', "oops"
    rows = [(1, 1, bad), (1, 2, bad), (1, 3, bad), (1, 4, good),
            (2, 1, bad), (2, 2, '{"a":"two","b":"x"}'), (2, 3, good),
            (3, 1, good)]
    df = spark.createDataFrame(rows, "rid long, attempt int, raw string")
    best = {r.rid: (r.attempt, r.parsed.a) for r in M.first_valid(M.parse_strict(df, "raw", REQ), "rid").collect()}
    assert best == {2: (2, "two"), 3: (1, "g")}


def test_keep_all_and_drop_policies(spark):
    recs = spark.createDataFrame([(1, "A", None, "out1"), (2, "B", "$1M", None)],
                                 "rid long, company_name string, funding_amount string, outcome string")
    resp = spark.createDataFrame(
        [(1, 1, '{"archetype":"x","fatal_action":"f","trigger_condition":"t","ultimate_outcome":"u"}'), (2, 1, "bad")],
        "rid long, attempt int, raw string")
    prof = {r.rid: r for r in M.profile_records(recs, M.first_valid(M.parse_strict(resp), "rid"), "rid").collect()}
    assert prof[1].archetype == "x" and prof[1].funding_amount == "N/A"
    assert prof[2].archetype == M.FAILED_ARCHETYPE and prof[2].ultimate_outcome == "N/A"
    stats = M.run_stats(M.profile_records(recs, M.first_valid(M.parse_strict(resp), "rid"), "rid")).first()
    assert (stats.total, stats.success, stats.failed, stats.saved) == (2, 1, 1, 2)

    recs2 = spark.createDataFrame([(1, "A", None, "desc", None), (2, "B", "fa", "desc", "orig"), (3, "C", None, None, None)],
                                  "id long, company_name string, fatal_action string, failure_reasons string, archetype string")
    resp2 = spark.createDataFrame([(1, '{"failure_reasons": null}'), (2, '{"industry": "x"}'), (3, "[1]")], "id long, raw string")
    fl = spark.createDataFrame([("A", "$5M")], "key string, value string")
    al = spark.createDataFrame([("B", "lookup_arch")], "key string, value string")
    out = {r.id: r for r in M.cleanse_records(recs2, M.parse_lenient(resp2), "id", fl, al).collect()}
    assert set(out) == {1, 2}  # the list answer is dropped
    assert out[1].industry == "Unknown" and out[1].failure_reasons is None and out[1].funding_amount == "$5M"
    assert out[1].archetype == "Unknown"
    assert out[2].failure_reasons == "fa" and out[2].archetype == "lookup_arch" and out[2].funding_amount == "Unknown"


def test_prompts_defaults(spark):
    df = spark.createDataFrame([(None, None, None)], "company_name string, fatal_action string, failure_reasons string")
    p = M.profile_prompt(df.select("company_name", *[F.lit(None).cast("string").alias(c) for c in
                                                     ["industry", "funding_amount", "failure_reasons", "outcome", "source_url"]]))
    t = p.first().prompt
    assert "* Unknown worked in N/A and had raised N/A" in t and "as noted: N/A" in t
    c = M.cleanse_prompt(df.withColumn("archetype", F.lit(None).cast("string"))).first().prompt
    assert 'Keep the archetype "Unknown"' in c and c.endswith("Note on Unknown: \n")
    own = M.cleanse_prompt(df.withColumn("archetype", F.lit("A")), template="{{{archetype}}}/{company_name}").first().prompt
    assert own == "{A}/Unknown"
    with pytest.raises(ValueError):
        M.profile_prompt(df, template="{nothing}")


def test_classification_answers(spark):
    rows = [(1, ' {"industry": "fintech", "archetype": "Echo"}\n'), (2, '```json\n{"industry": "x"}\n```'),
            (3, '[{"industry": "x"}]'), (4, '{"archetype": "Echo"}'), (5, '{"industry": null, "archetype": "A"}'),
            (6, "no idea")]
    df = spark.createDataFrame(rows, "id long, answer string")
    got = {r.id: (r.classified, r.industry, r.archetype) for r in M.parse_classification(df, "answer").collect()}
    assert got == {1: (True, "fintech", "Echo"), 2: (False, None, None), 3: (False, None, None),
                   4: (True, "", "Echo"), 5: (True, None, "A"), 6: (False, None, None)}
