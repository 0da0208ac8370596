"""Selectors over flattened pages, list cards, bodies, and records by a hot URL."""

import html
import random

import pytest
from pyspark.sql import functions as F

from precedent.functions import dom, selectors
from precedent.functions import html as H
from precedent.plans.q_harvest import ENTITY_CASES
from precedent.operators import harvest as HV

PAGE = """<div class="list w"><p id=1>a<p>b<div class="item">c<a href="/x" CLASS="big link">d<br>e</a></div></div>
<div class="lists"><div class="item"><a href="/y/z">f</a></div></div><a href="/x" class="">g</a><section class="my-list-x"><b><a>h</a></b></section>"""

WANTED = [
    ("a", ["de", "f", "g", "h"]), (".list .item a", ["de"]), (".list a, .lists a", ["de", "f"]), ("[class*='list'] a", ["de", "f", "h"]),
    ("a[href]", ["de", "f", "g"]), ("a[href='/x']", ["de", "g"]), ("a[href^='/y'], .big", ["de", "f"]), ("a[href$=z]", ["f"]),
    ("a.big.link[href*='x']", ["de"]), (".item", ["cde", "f"]), ("[class~='w'] *", ["a", "bcde", "cde", "de", ""]), ("section b a", ["h"]),
    (".item .item", []), ("nav a", []), ("a[class]", ["de", "g"]), ("a[class*='']", []), ("A", ["de", "f", "g", "h"]),
]


def test_selectors(spark):
    texts, elements = dom.flatten(PAGE)
    row = spark.createDataFrame([(texts, elements)], dom.SCHEMA)
    text = lambda e: F.array_join(F.transform(F.slice("texts", e["lo"] + 1, e["hi"] - e["lo"]), lambda t: F.trim(t["value"])), "")
    got = row.select(*[F.transform(selectors.select(F.col("elements"), s), text).alias(f"c{i}") for i, (s, _) in enumerate(WANTED)]).first()
    assert [list(v) for v in got] == [w for _, w in WANTED]
    for bad in ("", "a >b", "a[title]", "a..b", "a:hover", "a[href"):
        with pytest.raises(ValueError):
            selectors.parse(bad)
    with pytest.raises(ValueError):
        selectors.first_inside(F.col("elements"), F.col("e"), ".a .b")


def test_elements_know_what_they_enclose():
    _, elements = dom.flatten("<div><p>a<b>x</b><p>c</div><i></i><br/><img class='1' class='2'>")
    assert [(e[1], e[2], e[5], e[6]) for e in elements] == [
        ("div", -1, 4, None), ("p", 0, 3, None), ("b", 1, 3, None), ("p", 0, 4, None), ("i", -1, 5, None), ("br", -1, 6, None), ("img", -1, 7, "1")]


def test_cards(spark):
    card = ('<div class="collection-item"><a href="{h}"> <div class="my-title"> T{i} </div><span class="tags">Ind &amp; Co</span>'
            '<p> some <b>text</b></p></a></div>')
    rows = [
        (1, "http://s.org/l", "<div class='collection-list'>" + "".join(card.format(h=h, i=i) for i, h in enumerate(["/c/a", "/c/a", "http://o/x/y", "", "/"]))
         + "</div><a href='/cemetery/z'>no</a>"),
        (2, "http://s.org/l", "<a href='/about'>x</a><a href='/failures/q1'>" + "n" * 90 + "<h4></h4></a>"),
        (3, "http://s.org/l", None), (4, None, card.format(h="/c/a", i=9)), (5, "http://s.org/l", "<a>none</a>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in HV.list_cards(pages, selector=".collection-list .collection-item a, .gone a",
                                                 fallback=r"/(cemetery|failures)/[a-z0-9-]+").collect())
    assert got == [(1, 0, "/c/a", "http://s.org/c/a", "T0", "Ind & Co", "sometext"), (1, 2, "http://o/x/y", "http://o/x/y", "T2", "Ind & Co", "sometext"),
                   (2, 0, "/failures/q1", "http://s.org/failures/q1", "n" * 80, "", "")]


def test_bodies_in_every_container(spark):
    p = [c * 60 for c in "abcdefg"]
    rows = [(1, f"<main><p>{p[0]}</p></main>"), (2, f"<article><p>x</p></article><article><p>{p[0]}<p>{p[1]}</article>"),
            (3, f"<p>{p[0]}</p><div class='w-richtext z'><ul><li><p>{p[1]}</p></li></ul></div>"),
            (4, f"<main><article><div class='rich-text'><p>{p[0]}</p></div><p>{p[1]}</p></article></main><main><p>{p[2]}</p><p>{p[3]}</p></main>"),
            (5, f"<div class='rich-texts'><p>{p[0]}</p></div>"), (6, None), (7, "")]
    got = {r.page_id: r.body for r in HV.detail_fields(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: p[0], 2: f"{p[0]} {p[1]}", 3: p[1], 4: f"{p[0]} {p[1]} {p[2]}", 5: "", 6: "", 7: ""}


def test_records_with_a_hot_url_and_several_pages_of_one(spark):
    items = [(f"i{k}", "n", "http://s/home" if k % 3 else f"http://s/d{k}", "", "snip") for k in range(900)] + [("null", "n", None, "", "s")]
    items = spark.createDataFrame(items, "item_id string, name string, url string, industry string, snippet string").repartition(4)
    pages = [(5, "http://s/home", "<h1>Second</h1>"), (2, "http://s/home", "<h1>First</h1>"), (7, None, "<h1>none</h1>"), (8, "http://s/d3", "<h1>Three</h1>")]
    details = HV.details_with_tree(spark.createDataFrame(pages, "page_id long, url string, html string"))
    out = {r.item_id: r for r in HV.merge_details(items, details).collect()}
    assert len(out) == 901 and sum(r.company_name == "First" for r in out.values()) == 600
    assert out["i3"].company_name == "Three" and out["i3"].failure_reasons == "snip"
    assert not out["i6"].has_detail and not out["null"].has_detail and out["null"].source_url == ""
    none = HV.merge_details(items.limit(0), details)
    assert none.count() == 0


def test_references_are_read_as_the_parser_reads_them(spark):
    rng = random.Random(5)
    names = rng.sample(sorted(html.entities.html5), 300)
    parts = ["&", ";", "&#", "x", "amp", "&amp;", "&lt", "&#x", "é", "😀", " ", "\n", "<", "&notin;", "&notinx", "&" + "z" * 40 + ";"]
    texts = [f"a&{n}b&{n.rstrip(';')} c" for n in names] + [f"&#{n};&#x{n:x} " for n in [*range(0, 300), 0x2019, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF,
             0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 99999999, 10**12]] + ["&#0000000000065;", "", "plain", *[a for a, _ in ENTITY_CASES]]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string")
    got = {r.i: r.u for r in rows.select("i", H.unescape("t").alias("u")).collect()}
    assert got.pop(-1) is None
    wrong = [(texts[i], u, html.unescape(texts[i])) for i, u in got.items() if u != html.unescape(texts[i])]
    assert not wrong, wrong[:5]


def test_plain_pages_are_cut_as_the_parser_reads_them(monkeypatch):
    bits = ["<p>", "</p>", '<div class="a b">', "</div>", "<a href='/x'>", "</a>", "<br/>", "<br />", '<img src="q" />', "<h1>", "</h1>", "text", "\n", "&amp;",
            "&lt", "&", "<", ">", '"', "<!-- c -->", "<!doctype html>", "<script>", "</script>", "<title>", "</title>", "<P>", "<p >", "<a href=x>", "<p/>",
            '<a href="a&amp;b">', '<a href="">', "</ p>", '<a class="1" class="2">', "<a class>", '<a href="x>y">', '<a href="l\nm">', "é", "<é>", "<plaintext>"]
    rng = random.Random(7)
    pages = [None, "", "no tags & all"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(5000)]
    plain = "<html><body><h1>T &amp; U</h1><main><p class='x'>one<br/>two</p></main></body></html>"
    assert dom._Flat().plain(plain) and not dom._Flat().plain(plain + "<!-- c -->")
    assert sum(dom._Flat().plain(p or "") for p in pages) > 500

    def read(p):
        try:
            return dom.flatten(p)
        except Exception as e:
            return type(e)

    got = [read(p) for p in [*pages, plain]]
    monkeypatch.setattr(dom._Flat, "plain", lambda page, html: False)
    assert got == [read(p or "") for p in [*pages, plain]]
