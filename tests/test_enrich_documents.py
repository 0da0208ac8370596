from pyspark.sql import functions as F

from precedent.functions.text import between_markers
from precedent.operators import documents as D
from precedent.operators import enrich as J
from precedent.operators import quality as V


def test_lookup_last_wins_and_skips(spark):
    src = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("", "x", 3), ("b", "", 4), ("c", None, 5)],
                                "k string, v string, pos long")
    assert sorted(tuple(r) for r in J.build_lookup(src, "k", "v", "pos").collect()) == [("a", "2")]


def test_enrich_and_patches(spark):
    lk = spark.createDataFrame([("A", "$1M"), ("B", "$2M")], "key string, value string")
    recs = spark.createDataFrame([("A", "Unknown", "$1M"), ("B", "x", "old"), ("C", "Unknown", None)],
                                 "name string, arch string, fund string")
    e = {r.name: r.f for r in J.enrich(recs, lk, "name", "f").collect()}
    assert e == {"A": "$1M", "B": "$2M", "C": "Unknown"}
    p = {r.name: (r.arch, r.patched) for r in J.patch_conditional(recs, lk, "name", "arch").collect()}
    assert p == {"A": ("$1M", True), "B": ("x", False), "C": ("Unknown", False)}
    o = J.patch_overwrite(recs, lk, "name", "fund")
    assert {r.name: (r.fund, r.changed) for r in o.collect()} == {"A": ("$1M", False), "B": ("$2M", True), "C": ("", False)}
    again = J.patch_overwrite(o.drop("changed"), lk, "name", "fund")
    assert {r.name: r.changed for r in again.collect()} == {"A": False, "B": False, "C": False}
    st = J.patch_stats(o, {"fixed": "changed"}).first()
    assert (st.fixed, st.total) == (1, 3)


def test_between_markers(spark):
    rows = [("I. Reasons: R1. Archetype: A.",), ("no markers",), ("Reasons: only start",),
            (". Archetype: before Reasons: x",)]
    df = spark.createDataFrame(rows, "t string").select(between_markers(F.col("t"), "Reasons: ", ". Archetype:").alias("r"))
    assert [r.r for r in df.collect()] == ["R1", "no markers", "Reasons: only start", ""]


def test_document_build_and_ids(spark):
    df = spark.createDataFrame([(f"n{i}", "ind", "why.", "arc", "$1") for i in range(40)],
                               "company_name string, industry string, failure_reasons string, archetype string, funding_amount string")
    doc = D.build_document(df).first()
    assert doc.document == "Industry: ind. Reasons: why.. Archetype: arc." and doc.company_name not in doc.document
    ids = D.assign_ids(df.repartition(5), ["company_name"], prefix="case_")
    got = sorted((r.company_name, r.doc_id) for r in ids.collect())
    names = sorted(f"n{i}" for i in range(40))
    assert got == [(n, f"case_{i}") for i, n in enumerate(names)]


def test_positions_keep_every_wide_row_whatever_the_plan(spark):
    n = 120_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("payload"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for adaptive, advisory in (("true", "64m"), ("true", "1m"), ("false", "64m")):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
            spark.conf.set("spark.sql.shuffle.partitions", "16")
            out = D.assign_positions(df, ["k"])
            got = out.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.count("payload")).first()
            assert tuple(got) == (n, n, 0, n - 1, n)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_validate_and_audits(spark):
    df = spark.createDataFrame([(1, "  hi \n"), (2, " \t "), (3, None)], "id long, t string")
    got = {r.id: (r.request, r.status, r.reason) for r in V.validate_requests(df, "t").collect()}
    assert got == {1: ("hi", "ok", None), 2: ("", "rejected", "blank"), 3: (None, "rejected", "missing")}
    docs = spark.createDataFrame([("Acme", "acme failed"), ("Bolt", "other")], "name string, doc string")
    a = V.audit_name_leak(docs, "name", "doc").first()
    assert (a.n_docs, a.n_leaks) == (2, 1)
    vals = spark.createDataFrame([("$80",)] * 3 + [("$1M",)], "v string")
    m = {r.value: r.suspicious for r in V.audit_modal_value(vals, "v", 0.5).collect()}
    assert m == {"$80": True, "$1M": False}
