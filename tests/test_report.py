from pyspark.sql import functions as F

from precedent.functions.text import pad2, subject_tag
from precedent.operators import report as P
from precedent.operators import retrieve as R


def test_threat_bands_and_match_percent(spark):
    rows = [(1, 1, 0.4999), (1, 2, 0.5), (1, 3, 0.7999), (2, 1, 0.8), (2, 2, 0.005), (2, 3, 1.7)]
    df = spark.createDataFrame(rows, "query_id long, rank long, distance double")
    got = {(r.query_id, r.rank): (r.threat, r.match_percent) for r in P.threat(df).collect()}
    assert got[(1, 1)] == ("CRITICAL", 50) and got[(1, 2)] == ("HIGH", 50)
    assert got[(1, 3)][0] == "HIGH" and got[(2, 1)] == ("MODERATE", 20)
    assert got[(2, 2)][1] == 100 and got[(2, 3)][1] == 0  # 99.5 rounds half-up, negatives clamp to 0


def test_tags_and_labels(spark):
    df = spark.createDataFrame([("Acme  Rocket\tWorks Limited Holdings", 3), ("x", 12), ("y", 123)], "n string, r long")
    out = df.select(subject_tag(F.col("n")).alias("t"), pad2(F.col("r")).alias("p")).collect()
    assert out[0].t == "#ACME_ROCKET_WORKS_LI-CASE"
    assert [o.p for o in out] == ["03", "12", "123"]


def test_lines_keep_untrimmed_nonblank(spark):
    df = spark.createDataFrame([(1, "a\n\n  \n b \nc")], "id long, text string")
    got = [(r.line_no, r.line) for r in P.lines(df, ["id"]).collect()]
    assert got == [(0, "a"), (1, " b "), (2, "c")]


def test_prompt_summary_and_nested_matches(spark):
    res = spark.createDataFrame(
        [(1, 2, "B", "$2M", "arc2", "ind", "Industry: ind. Reasons: second.. Archetype: arc2.", 0.3),
         (1, 1, "A", None, "arc1", "ind", "Industry: ind. Reasons: first.. Archetype: arc1.", 0.1)],
        "query_id long, rank long, company_name string, funding_amount string, archetype string, industry string, "
        "document string, distance double")
    q = spark.createDataFrame([(1, "my idea")], "query_id long, query_text string")
    msg = P.prompt_messages(res, q).first()
    assert [m.role for m in msg.messages] == ["system", "user"]
    user = msg.user_message
    assert "my idea" in user and user.index("(1) arc1") < user.index("(2) arc2") and "Venture: A; capital raised: \n" in user
    own = P.prompt_messages(res, q, case_template="{rank}={company_name}", separator="+", user_template="{cases}?{request}").first()
    assert own.user_message == "1=A+2=B?my idea"
    one = P.sheet(res).first()
    assert (one.target_id, one.distance, one.match_percent, one.threat, len(one.matched_cases)) == ("A", 0.1, 90, "CRITICAL", 2)
    assert one.case_text in user
    s = P.summary(res).first()
    assert (s.target_id, s.outcome, s.distance) == ("A", "Raised Unknown, then failed: first.", 0.1)
    m = P.matched_cases(res).first().matched_cases
    assert [c.company_name for c in m] == ["A", "B"] and m[1].failure_reasons == "second."


def test_matched_names_in_rank_order(spark):
    res = spark.createDataFrame([(1, 2, "B"), (1, 1, None), (1, 3, "C")], "query_id long, rank long, company_name string")
    r = R.matched_names(res).first()
    assert (r.matched_names, r.n_matches) == ("N/A, B, C", 3)
