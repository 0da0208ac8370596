import pytest

from precedent.functions import detail_rules as rules
from precedent.functions import dom
from precedent.functions.text import truncate_marked
from precedent.operators import harvest as HV
from precedent.plans import q_harvest
from precedent.session import spread
from pyspark.sql import functions as F
from tests.conftest import SMOKE

LIST_HTML = (
    '<html><body><script>var s = "<a href=\\"/Hidden\\">x</a>";</script>'
    '<a href="/Alpha"><h3>Alpha Co</h3><p>snip</p></a>'
    '<a href="/Alpha">dup</a>'
    '<a href="http://x.com/a/b/c">abs</a>'
    '<a href="">empty</a>'
    '<a href="/Beta">' + "B" * 100 + "</a>"
    "</body></html>"
)


def test_list_links(spark):
    pages = spark.createDataFrame([(1, "http://site.com/list", LIST_HTML)], "page_id long, url string, html string")
    got = [(r.pos, r.href, r.url, r.name) for r in
           HV.list_links(pages, primary=r"^/[A-Z]|^http", min_slashes=3).orderBy("pos").collect()]
    assert got == [
        (0, "/Alpha", "http://site.com/Alpha", "Alpha Co"),
        (2, "http://x.com/a/b/c", "http://x.com/a/b/c", "abs"),
        (3, "/Beta", "http://site.com/Beta", "B" * 80),
    ]
    strict = HV.list_links(pages, primary=r"^/[A-Z]|^http", min_slashes=4).collect()
    assert [r.href for r in strict] == ["http://x.com/a/b/c"]


def test_backup_list_and_cap(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.com/l", '<a href="/x">x</a><a href="/y">y</a><a href="/z">z</a>'),
         (2, "http://b.com/l", '<a href="/Q">q</a>')], "page_id long, url string, html string")
    links = HV.list_links(pages, primary=r"^/[A-Z]", fallback=r"^/[a-z]", min_slashes=3)
    assert sorted((r.page_id, r.href) for r in links.collect()) == [(1, "/x"), (1, "/y"), (1, "/z"), (2, "/Q")]
    assert sorted(r.href for r in HV.cap_items(links, 2).where("page_id = 1").collect()) == ["/x", "/y"]
    site = F.regexp_extract("url", "//([^/]*)", 1).alias("site")
    prim = HV.list_links(pages, primary=r"^/[A-Z]", min_slashes=3).join(pages.select("page_id", site), "page_id")
    back = HV.list_links(pages, primary=r"^/[a-z]", min_slashes=3).join(pages.select("page_id", site), "page_id")
    got = sorted((r.site, r.href) for r in HV.with_backup(prim, back).collect())
    assert got == [("a.com", "/x"), ("a.com", "/y"), ("a.com", "/z"), ("b.com", "/Q")]


def test_detail_fields(spark):
    p50, p51 = "x" * 50, "y" * 51
    html = f"<html><body><article><p>{p50}</p><p><b>{p51}</b><p>{'z' * 60}</p></article></body></html>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = HV.detail_fields(pages).first()
    assert r.title == "" and r.body == f"{p51} {'z' * 60}"
    t = spark.createDataFrame([("a" * 800,), ("b" * 801,)], "t string").select(truncate_marked(F.col("t")).alias("u"))
    assert [len(x.u) for x in t.collect()] == [800, 803]


def test_a_page_that_could_not_be_parsed_is_no_page_without_a_body(spark, monkeypatch):
    from types import SimpleNamespace

    flatten = dom.flatten

    def refuse(html):
        if html and "refused" in html:
            raise ValueError("refused")
        return flatten(html)

    monkeypatch.setattr(HV, "dom", SimpleNamespace(SCHEMA=dom.SCHEMA, flatten=refuse))
    long = "x" * 900
    rows = [(1, f"<h1>A</h1><main><p>{long}</p></main>"), (2, f"<h1>refused</h1><main><p>{long}</p></main>"), (3, "<p>short</p>"), (4, None)]
    got = {r.page_id: tuple(r)[1:] for r in HV.detail_fields(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: ("A", long, long[:800] + "...", "ok"), 2: (None, None, None, "error"), 3: ("", "", "", "ok"), 4: ("", "", "", "ok")}


@pytest.mark.parametrize("odd", ["<![foo[x]]>", "<![ x ]>", "<![%[>", "<![[>", "<![>", "<![foo>"])
def test_marked_sections_of_any_name_leave_the_page_whole(spark, tmp_path, odd):
    """As the SQL has it: up to the next '>' they count as a tag."""
    import duckdb

    from precedent.plans.catalog import ORACLE

    long = "One paragraph that is longer than fifty characters in all."
    pages = spark.createDataFrame([(1, "http://a.com", f"<html>{odd}<main><h1>T</h1><p>{long}</p></main></html>")], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = [tuple(r) for r in q_harvest.harvest_truncate(spark, str(tmp_path)).collect()]
    assert got == con.execute(ORACLE["harvest_truncate"]).fetchall() == [(1, long)]


RULE_CASES = [
    ("industry", "<div><span>Industry</span><span>Fintech</span></div>", "Fintech"),
    ("industry", "<div><p>Sector: Retail</p></div>", "Retail"),
    ("industry", "<div><span>Category</span><span></span></div>", ""),
    ("funding", "<div><b>Funding</b> $5M raised</div>", "$5M"),
    ("funding", "<p>They got $3 million total.</p>", "$3 million"),
    ("funding", "<p>nothing</p>", ""),
    ("section", "<h2>Why did it fail?</h2><p>First.</p><ul><li>a</li><li>b</li></ul><h2>Next</h2><p>x</p>", "First. a; b"),
    ("section", "<p>plain</p>", ""),
    ("section", "<div><h3><i>Lessons</i></h3><div>no</div><p> A <b>b</b></p></div><p>far</p>", "Ab"),
    ("section", "<h2>Reason</h2><h2>Cause</h2><p>late</p>", "late"),
    ("outcome", "<p>Status: closed 2019</p>", "closed 2019"),
    ("outcome", "<p>The shop closed in May. Then more</p>", "closed in May."),
    ("outcome", "<p>It shut down in May. Then more</p>", "It shut down in May. Then more"),
    ("outcome", "<p>quiet</p>", rules.OUTCOME_DEFAULT),
    ("outcome", "", rules.OUTCOME_DEFAULT),
    ("outcome", None, rules.OUTCOME_DEFAULT),
    ("outcome", "<script>Status: no</script><!-- Result: no --><p>Result : 1 < 2</p>", "1 < 2"),
]


def test_tree_rules(spark):
    rows = [(i, html) for i, (_, html, _) in enumerate(RULE_CASES)]
    got = {r.page_id: r for r in HV.tree_fields(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert [got[i][c] for i, (c, _, _) in enumerate(RULE_CASES)] == [want for _, _, want in RULE_CASES]
    assert all(r.status == "ok" for r in got.values())
    given = spark.createDataFrame([(1, "<p>none</p>", "Given")], "page_id long, html string, industry string")
    assert HV.tree_fields(given, preview_industry="industry").first().industry == "Given"


def test_deeply_nested_page(spark):
    deep = "<li>" * 100_000 + "Status: deep"
    texts, elements = dom.flatten(deep)
    assert len(elements) == 100_000 and texts == [("Status: deep", 0, 1, None, None, None)]
    rows = [(1, deep), (2, "<p>Status: fine</p>")]
    got = HV.tree_fields(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id").collect()
    assert [(r.outcome, r.status) for r in got] == [("deep", "ok"), ("fine", "ok")]


def test_merge_with_and_without_detail(spark):
    items = spark.createDataFrame(
        [("i1", "Prev", "http://s/d1", "", "snip"), ("i2", "Gone", "http://s/none", "", "snip2")],
        "item_id string, name string, url string, industry string, snippet string")
    pages = spark.createDataFrame([(1, "http://s/d1", "<html><body><p>Outcome: sold</p></body></html>")],
                                  "page_id long, url string, html string")
    out = {r.item_id: r for r in HV.merge_details(items, HV.details_with_tree(pages)).collect()}
    assert out["i1"].company_name == "Prev" and out["i1"].failure_reasons == "snip" and out["i1"].outcome == "sold"
    assert out["i2"].funding_amount == "N/A" and out["i2"].outcome == "N/A" and out["i2"].failure_reasons == "snip2"
    assert out["i1"].has_detail and not out["i2"].has_detail


def test_made_pages_fill_all_tasks(spark):
    from precedent.plans import q_harvest as Q
    from tests.conftest import SMOKE

    for pages in (Q.entity_pages(spark, SMOKE), Q.labelled_pages(spark, SMOKE), Q.site_pages(spark, SMOKE).where("page_id >= 0")):
        sizes = [r["count"] for r in pages.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) <= sum(sizes) / 2  # one row group, yet no task has most of the pages


def test_pages_are_flattened_in_slices(monkeypatch):
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    pages = [f"<div><p>{i}</p>{'<b>x</b>' * (i % 9)}</div>" if i % 11 else None for i in range(300)] + ["<p>" + "y" * 500 + "</p>", ""]
    found = to_arrow_schema(T._parse_datatype_string(f"{dom.SCHEMA}, status string"))
    monkeypatch.setattr(HV, "SLICE", 400)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], names=["page_id", "_html"])
    out = list(HV._flatten(found)([batch]))
    assert len(out) > 10 and max(b.num_rows for b in out) < 100
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["page_id"] for r in rows] == list(range(len(pages))) and {r["status"] for r in rows} == {"ok"}
    for html, r in zip(pages, rows):
        texts, elements = dom.flatten(html)
        assert [tuple(t.values()) for t in r["texts"]] == texts and [tuple(e.values()) for e in r["elements"]] == elements


@pytest.mark.parametrize("splits", [1, 2])
def test_a_row_group_larger_than_a_split_is_dealt_over_all_slots(spark, tmp_path, splits):
    slots, path = spark.sparkContext.defaultParallelism, str(tmp_path / "part.parquet")
    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.sha2(F.col("id").cast("string"), 256).alias("p_name")).coalesce(1).write.parquet(path)
    size = max(f.stat().st_size for f in (tmp_path / "part.parquet").glob("*.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // (splits * slots - splits + 1) + 1))
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= slots and len(df.groupBy(F.spark_partition_id()).count().collect()) == 1
        rows = [r["count"] for r in spread(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(rows) == 20_000 and max(rows) <= 1.1 * 20_000 / slots + slots


def test_spread_leaves_a_table_of_many_partitions_alone(spark):
    df = spark.range(100).repartition(2 * spark.sparkContext.defaultParallelism)
    assert spread(df) is df


def test_detail_pages_of_one_row_group_are_flattened_in_all_slots(spark, tmp_path):
    slots, path = spark.sparkContext.defaultParallelism, tmp_path / "part.parquet"
    k = F.col("id")
    spark.range(7_000).select(k.alias("p_partkey"), F.sha2(k.cast("string"), 256).alias("p_name"), F.concat(F.lit("type "), k % 9).alias("p_type"),
                              F.lit("brand").alias("p_brand"), (k % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(str(path))
    size = max(f.stat().st_size for f in path.glob("*.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // slots + 1))
        pages = q_harvest.site_pages(spark, str(tmp_path)).where("page_id >= 0")
        rows = [r["count"] for r in HV.detail_fields(pages).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(rows) == 6_000 and max(rows) <= 2 * 6_000 / slots


def test_building_bodies_runs_no_shuffle(spark):
    pages = q_harvest.site_pages(spark, SMOKE).where("page_id >= 0")
    spark.sparkContext.setJobGroup("build-bodies", "")
    try:
        built = HV.detail_fields(pages, dealt=True)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("build-bodies")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert not list(jobs)
    got = {tuple(r) for r in built.collect()}
    assert len(got) == pages.count() and got == {tuple(r) for r in HV.detail_fields(pages).collect()}
