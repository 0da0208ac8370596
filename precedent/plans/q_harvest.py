"""Harvest queries (H1-H18) on pages, and on HTML synthesised from part and
documents rows for the label / amount / outcome / section rules (the driver
pages carry no such labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from precedent.functions import html as H
from precedent.functions.detail_rules import OUTCOME_DEFAULT
from precedent.operators import harvest as HV
from precedent.plans.catalog import register
from precedent.plans.tables import read
from precedent.session import spread

PRIMARY = r"^/[A-Z]"
BACKUP = r"^/[a-z]"
MIN_SLASHES = 3
LIST_CAP = 5

# ---------------------------------------------------------------- SQL mirrors of functions.html
NOISE_SQL = "'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->'"


# the references that the driver's pages hold, and some more; &amp; last, so that
# what it escapes stays
PAGE_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&copy;": "©", "&middot;": "·",
                   "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&#8217;": "’", "&rsquo;": "’", "&eacute;": "é", "&amp;": "&"}


def unescape_sql(x: str) -> str:
    for k, v in PAGE_REFERENCES.items():
        v = v.replace("'", "''")
        x = f"replace({x}, '{k}', '{v}')"
    return x


def text_of_sql(x: str) -> str:
    return ("regexp_replace(" + unescape_sql(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
            + ", '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')")


CLEAN_SQL = f"""
clean AS (SELECT page_id, url, regexp_replace(html, {NOISE_SQL}, '', 'g') AS h FROM pages)"""

ANCHOR = "'(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>'"

LINKS_CTES = f"""
anch AS (
  SELECT page_id, url, list_zip(regexp_extract_all(h, {ANCHOR}, 1), regexp_extract_all(h, {ANCHOR}, 2)) AS its FROM clean),
chosen AS (
  SELECT page_id, url,
         CASE WHEN len(list_filter(its, lambda x: regexp_matches(x[1], '{PRIMARY}'))) > 0
              THEN list_filter(its, lambda x: regexp_matches(x[1], '{PRIMARY}'))
              ELSE list_filter(its, lambda x: regexp_matches(x[1], '{BACKUP}')) END AS ch,
         regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS base
  FROM anch),
ex AS (
  SELECT page_id, base, unnest(ch) AS it, generate_subscripts(ch, 1) - 1 AS pos FROM chosen),
lk AS (
  SELECT page_id, CAST(pos AS BIGINT) AS pos, it[1] AS href,
         CASE WHEN starts_with(it[1], 'http') THEN it[1] ELSE base || it[1] END AS url,
         CASE WHEN {text_of_sql("regexp_extract(it[2], '(?is)<h[234][^>]*>(.*?)</h[234]>', 1)")} <> ''
              THEN {text_of_sql("regexp_extract(it[2], '(?is)<h[234][^>]*>(.*?)</h[234]>', 1)")}
              ELSE substring({text_of_sql("it[2]")}, 1, 80) END AS name
  FROM ex WHERE it[1] <> ''),
links AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS k FROM lk
    WHERE length(url) - length(replace(url, '/', '')) >= {MIN_SLASHES})
  WHERE k = 1)"""
LINKS_SQL = "WITH " + CLEAN_SQL.strip() + "," + LINKS_CTES + "\n"


def _links(spark, d):
    return HV.list_links(read(spark, d, "pages"), primary=PRIMARY, fallback=BACKUP, min_slashes=MIN_SLASHES)


# ---------------------------------------------------------------- H1-H5
@register("harvest_links", LINKS_SQL + "SELECT page_id, pos, href, url, name FROM links")
def harvest_links(spark, d):
    return _links(spark, d)


# ---------------------------------------------------------------- H7
@register(
    "harvest_limit",
    LINKS_SQL + f"""
SELECT page_id, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM links)
WHERE r <= {LIST_CAP}""",
)
def harvest_limit(spark, d):
    return HV.cap_items(_links(spark, d), LIST_CAP).select("page_id", "pos", "url")


# ---------------------------------------------------------------- H6
def _site_items(spark, d, pattern):
    p = read(spark, d, "pages")
    links = HV.list_links(p, primary=pattern, min_slashes=MIN_SLASHES)
    site = p.select("page_id", F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1).alias("site"))
    return links.join(site, "page_id").select("site", "page_id", "pos", "url")


def _site_sql(pattern: str) -> str:
    return f"""
SELECT site, page_id, pos, url FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS k FROM (
    SELECT page_id, regexp_extract(purl, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS site, CAST(pos AS BIGINT) AS pos,
           it[1] AS href, CASE WHEN starts_with(it[1], 'http') THEN it[1] ELSE base || it[1] END AS url
    FROM (SELECT page_id, purl, base, unnest(ch) AS it, generate_subscripts(ch, 1) - 1 AS pos FROM (
            SELECT page_id, url AS purl, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS base,
                   list_filter(list_zip(regexp_extract_all(h, {ANCHOR}, 1), regexp_extract_all(h, {ANCHOR}, 2)),
                               lambda x: regexp_matches(x[1], '{pattern}')) AS ch FROM clean))
    WHERE it[1] <> '')
  WHERE length(url) - length(replace(url, '/', '')) >= {MIN_SLASHES})
WHERE k = 1"""


@register(
    "harvest_backup_source",
    f"WITH {CLEAN_SQL.strip()},\nprim AS ({_site_sql(PRIMARY)}),\nback AS ({_site_sql(BACKUP)})\n"
    "SELECT * FROM prim UNION ALL SELECT * FROM back WHERE site NOT IN (SELECT site FROM prim)",
)
def harvest_backup_source(spark, d):
    return HV.with_backup(_site_items(spark, d, PRIMARY), _site_items(spark, d, BACKUP))


# ---------------------------------------------------------------- H8, H12, H14
# the tree keeps text nodes apart where markup or noise stands between them, strips
# each and joins them
MARKED_SQL = f"""
marked AS (SELECT page_id, url, regexp_replace(html, {NOISE_SQL}, '<!>', 'g') AS h FROM pages)"""


def nodes_sql(x: str) -> str:
    node = f"regexp_replace({unescape_sql('n')}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
    return f"array_to_string(list_transform(regexp_split_to_array({x}, '</?[a-zA-Z!][^>]*>'), lambda n: {node}), '')"


DETAIL_CTES = f"""
parts AS (
  SELECT page_id, url,
         {nodes_sql("regexp_extract(h, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1)")} AS title,
         flatten(list_transform(regexp_extract_all(h, '(?is)<(?:article|main)(?:\\s[^>]*)?>(.*?)</(?:article|main)>', 1),
           lambda a: list_transform(regexp_split_to_array(a, '(?i)<p(?:\\s[^>]*)?>')[2:],
                                    lambda c: regexp_replace(c, '(?is)</p>.*$', '')))) AS chunks
  FROM marked),
det AS (
  SELECT page_id, url, title,
         array_to_string(list_slice(list_filter(list_transform(chunks, lambda x: {nodes_sql("x")}),
                                                lambda p: length(p) > 50), 1, 3), ' ') AS body
  FROM parts)"""
DETAIL_SQL = "WITH " + MARKED_SQL.strip() + "," + DETAIL_CTES + "\n"


@register("harvest_page_fields", DETAIL_SQL + "SELECT page_id, title, body FROM det")
def harvest_page_fields(spark, d):
    return HV.detail_fields(read(spark, d, "pages")).select("page_id", "title", "body")


@register(
    "harvest_truncate",
    DETAIL_SQL + "SELECT page_id, CASE WHEN length(body) > 800 THEN substring(body, 1, 800) || '...' ELSE body END AS body_truncated FROM det",
)
def harvest_truncate(spark, d):
    return HV.detail_fields(read(spark, d, "pages")).select("page_id", "body_truncated")


# ---------------------------------------------------------------- H16
@register(
    "harvest_page_text",
    f"SELECT page_id, {unescape_sql(f'regexp_replace(regexp_replace(html, {NOISE_SQL}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)}), {chr(39)}<[^>]*>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')} AS text FROM pages",
)
def harvest_page_text(spark, d):
    return HV.page_text(read(spark, d, "pages"))


def entity_pages(spark, d):
    """Parts as pages whose title and text hold named, numeric, unfinished and
    meaningless references."""
    p = spread(read(spark, d, "part"))
    n = F.col("p_partkey").cast("string")
    some = F.element_at(F.array(*[F.lit(x) for x, _ in ENTITY_CASES]), (F.col("p_partkey") % len(ENTITY_CASES)).cast("int") + 1)
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(
        F.lit("<html><h1> "), F.col("p_name"), F.lit(" "), some, F.lit("</h1><p>No. &#"), (F.col("p_size") + 945).cast("string"), F.lit(";, &#x"),
        F.lower(F.hex(F.col("p_size") + 945)), F.lit(" and "), some, n, F.lit("</p></html>")).alias("html"))


# references and what they stand for
ENTITY_CASES = [
    ("a &mdash; b", "a — b"), ("it&#8217;s", "it’s"), ("caf&eacute;", "café"), ("&copy 2020", "© 2020"), ("&notit; x", "¬it; x"),
    ("&amp;lt;b&amp;gt;", "&lt;b&gt;"), ("&#x1F600;!", "😀!"), ("&#128;&#x99;", "€™"), ("&nosuch; &", "&nosuch; &"), ("&NotEqualTilde;.", "≂̸."),
    ("&#0;&#55296;&#99999999999;", "\ufffd\ufffd\ufffd"), ("&#1;x&#65535;", "x"), ("R&D; Q&A", "R&D; Q&A"), ("&AMP&amp", "&&"), ("&frac12x", "½x")]


@register(
    "harvest_entities",
    "SELECT p_partkey AS page_id, p_name || ' ' || e AS title, ' ' || p_name || ' ' || e || 'No. ' || chr(p_size + 945) || ', ' || chr(p_size + 945) "
    "|| ' and ' || e || p_partkey AS text FROM (SELECT *, ["
    + ", ".join("'" + v.replace("'", "''") + "'" for _, v in ENTITY_CASES) + f"][p_partkey % {len(ENTITY_CASES)} + 1] AS e FROM part)",
)
def harvest_entities(spark, d):
    pages = entity_pages(spark, d)
    return pages.select("page_id", H.text_of(H.first_inner(F.col("html"), "h1")).alias("title"), H.visible_text(F.col("html")).alias("text"))


# ---------------------------------------------------------------- H13, H17, H18
def _items_for_merge(found):
    """List items: every resolved link of every page, plus each page listed
    under its own URL with its <title> as preview name."""
    links = HV.listed(found, MIN_SLASHES).select(
        F.concat(F.col("page_id").cast("string"), F.lit(":"), F.col("pos").cast("string")).alias("item_id"),
        "name", "url", "industry", "snippet")
    own = found.select(F.concat(F.col("page_id").cast("string"), F.lit(":self")).alias("item_id"),
                       F.col("heading").alias("name"), "url", F.lit("").alias("industry"), F.lit("").alias("snippet"))
    return links.unionByName(own)


@register(
    "harvest_fallback_merge",
    "WITH " + CLEAN_SQL.strip() + "," + MARKED_SQL + "," + LINKS_CTES + "," + DETAIL_CTES + f""",
items AS (
  SELECT CAST(page_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS item_id, name, url FROM links
  UNION ALL
  SELECT CAST(page_id AS VARCHAR) || ':self', {text_of_sql("regexp_extract(h, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1)")}, url FROM clean),
d AS (SELECT url, title, body FROM det WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT i.item_id,
       CASE WHEN d.url IS NULL THEN i.name WHEN d.title <> '' THEN d.title ELSE coalesce(i.name, 'Unknown') END AS company_name,
       'N/A' AS industry, 'N/A' AS funding_amount, -- pages carry none of the labels
       CASE WHEN d.url IS NULL THEN '' WHEN d.body = '' THEN 'N/A' WHEN length(d.body) > 800 THEN d.body[1:800] || '...' ELSE d.body END AS failure_reasons,
       CASE WHEN d.url IS NULL THEN 'N/A' ELSE '{OUTCOME_DEFAULT}' END AS outcome,
       i.url AS source_url, d.url IS NOT NULL AS has_detail
FROM items i LEFT JOIN d ON d.url = i.url""",
)
def harvest_fallback_merge(spark, d):
    found = HV.parse_pages(read(spark, d, "pages"), selector=None, fallback=(PRIMARY, BACKUP))
    out = HV.merge_details(_items_for_merge(found), found)
    return out.select("item_id", *HV.RECORD_COLUMNS).withColumn(
        "industry", F.when(F.col("industry") == "", F.lit("N/A")).otherwise(F.col("industry")))


# ---------------------------------------------------------------- H1, H5, H12, H13, H17, H18 on a made-up site
SITE = "http://cases.example.org"
# The card selectors and the fallback of the list pages.
CARD_SELECTOR = (".collection-list .collection-item a, .w-dyn-list .w-dyn-item a, "
                 "[class*='cemetery'] a[href*='/cemetery/'], a[href*='/cemetery/']")
CARD_FALLBACK = r"/(cemetery|failures)/[a-z0-9-]+"
PER_LIST = 10


def _part(spark, d):
    k = F.col("p_partkey")
    return spread(read(spark, d, "part")).select(
        k.alias("k"), "p_name", "p_type", "p_brand", "p_size", F.floor(k / PER_LIST).alias("list"),
        # cards of one list in four have other hrefs, so that only their classes tell them
        F.when(F.floor(k / PER_LIST) % 4 == 0, F.lit("/dossier/x/")).when(F.floor(k / PER_LIST) % 4 == 3, F.lit("/failures/x-"))
        .otherwise(F.lit("/cemetery/")).alias("dir"))


def site_pages(spark, d):
    """List pages of ten parts each and a detail page for six of seven parts. List pages
    come in four kinds: cards told by classes alone, by other classes and href, by a
    part of a class and href, and by the fallback. Every list also links to the home
    page, and repeats its first card."""
    p = _part(spark, d)
    lit, c = F.lit, F.col
    slug = F.concat("dir", lit("p"), c("k").cast("string"))
    kind = c("list") % 4
    name = F.when(c("k") % 3 == 0, F.concat(lit("<h3>"), "p_name", lit("</h3>"))).when(
        c("k") % 3 == 1, F.concat(lit('<div class="card-heading x"> <b>'), "p_name", lit("</b> </div>"))).otherwise(lit(""))
    tag = F.when(c("p_size") % 2 == 0, F.concat(lit('<span class="pill tag-blue">'), "p_type", lit("</span>"))).otherwise(lit(""))
    snip = F.when(c("p_size") % 3 == 0, F.concat(lit("<p>About "), "p_brand", lit(" &amp; more</p>"))).when(
        c("p_size") % 3 == 1, F.concat(lit("<div class=\'long-description\'>Says "), "p_brand", lit("</div>"))).otherwise(lit(""))
    inner = F.concat(lit('<a href="'), slug, lit('">'), name, tag, snip, F.when(c("k") % 3 == 2, F.concat(lit("Plain "), "p_name")).otherwise(lit("")), lit("</a>"))
    wrap = F.when(kind == 0, F.concat(lit('<div class="big collection-item">'), inner, lit("</div>"))).when(
        kind == 1, F.concat(lit('<li class="w-dyn-item">'), inner, lit("</li>"))).otherwise(inner)
    cards = p.select("list", "k", wrap.alias("w"))
    lists = cards.groupBy("list").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), "").alias("all"),
                                      F.min_by("w", "k").alias("again"))  # ten rows a list
    home = F.when(kind == 0, lit('<div class="collection-item"><a href="http://cases.example.org/cemetery/home">Home</a></div>')).when(
        kind == 3, lit('<a href="http://cases.example.org/failures/x-home">Home</a>')).otherwise(lit('<a href="http://cases.example.org/cemetery/home">Home</a>'))
    box = F.when(kind == 0, lit("collection-list w")).when(kind == 1, lit("w-dyn-list")).when(kind == 2, lit("my-cemetery-grid")).otherwise(lit("collection-lists"))
    lists = lists.select(
        (-c("list") - 1).alias("page_id"), F.concat(lit(SITE + "/list/"), c("list").cast("string")).alias("url"),
        F.concat(lit('<html><body><a href="/about">About</a><div class="'), box, lit('">'), "all", "again", home,
                 lit('</div><a class="collection-item" href="/x/y/z">out</a></body></html>')).alias("html"))
    text = F.concat(lit("The long story of "), "p_name", lit(", told at length and without haste, "), "p_brand")
    where = F.when(c("k") % 5 == 0, F.concat(lit("<h2>What went wrong</h2><p>It was "), "p_type", lit(".</p><ul><li>one</li><li>two</li></ul><h2>End</h2>"))).when(
        c("k") % 5 == 1, F.concat(lit("<article><p>short</p></article><article><p>"), text, lit("<p>"), text, lit(" again</article>"))).when(
        c("k") % 5 == 2, F.concat(lit("<main><div><p>"), text, lit("</p></div></main>"))).when(
        c("k") % 5 == 3, F.concat(lit("<main><div class='a rich-text b'><p>"), text, lit("</p></div></main><p>Outside any body, "), text, lit("</p>"))).otherwise(
        F.concat(lit("<p>Outside any body, "), text, lit("</p>")))
    head = F.when(c("p_size") % 10 != 0, F.concat(lit("<h1>The "), "p_name", lit("</h1>"))).otherwise(lit(""))
    label = F.when(c("p_size") % 5 == 1, F.concat(lit("<div><span>Sector</span><span>"), "p_brand", lit("</span></div>"))).otherwise(lit(""))
    fund = F.when(c("k") % 4 == 1, F.concat(lit("<div><b>Funding</b><p>Total of $"), c("p_size").cast("string"), lit("M so far</p></div>"))).otherwise(lit(""))
    end = F.when(c("k") % 3 == 1, F.concat(lit("<p>Outcome: sold to "), "p_brand", lit("</p>"))).otherwise(lit(""))
    details = p.where("k % 7 <> 3").select(
        c("k").alias("page_id"), F.concat(lit(SITE), slug).alias("url"),
        F.concat(lit("<html><body>"), head, label, fund, where, end, lit("</body></html>")).alias("html"))
    homes = spark.createDataFrame([(-1_000_000_000 - i, SITE + u, "<html><body><h1>Home</h1></body></html>") for i, u in
                                   enumerate(["/cemetery/home", "/failures/x-home"])], lists.schema)
    return lists.unionByName(details).unionByName(homes)


SITE_SQL = f"""
p AS (SELECT p_partkey AS k, p_name, p_type, p_brand, p_size, p_partkey // {PER_LIST} AS list,
        CASE (p_partkey // {PER_LIST}) % 4 WHEN 0 THEN '/dossier/x/' WHEN 3 THEN '/failures/x-' ELSE '/cemetery/' END || 'p' || p_partkey AS href FROM part),
own AS (
  SELECT list, k, href, row_number() OVER (PARTITION BY list ORDER BY k) - 1 AS pos,
    CASE k % 3 WHEN 2 THEN (CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END
        || CASE p_size % 3 WHEN 0 THEN 'About ' || p_brand || ' & more' WHEN 1 THEN 'Says ' || p_brand ELSE '' END || 'Plain ' || p_name)[1:80] ELSE p_name END AS name,
    CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS industry,
    CASE p_size % 3 WHEN 0 THEN 'About ' || p_brand || ' & more' WHEN 1 THEN 'Says ' || p_brand ELSE '' END AS snippet FROM p),
home AS (
  SELECT list, NULL::BIGINT AS k, '{SITE}' || CASE WHEN list % 4 = 3 THEN '/failures/x-home' ELSE '/cemetery/home' END AS href,
    max(pos) + 2 AS pos, 'Home' AS name, '' AS industry, '' AS snippet FROM own GROUP BY list),
cards AS (SELECT -list - 1 AS page_id, k, pos::BIGINT AS pos, href, CASE WHEN starts_with(href, 'http') THEN href ELSE '{SITE}' || href END AS url,
            name, industry, snippet FROM (SELECT * FROM own UNION ALL BY NAME SELECT * FROM home))"""


@register("harvest_cards", f"WITH {SITE_SQL.strip()}\nSELECT page_id, pos, href, url, name, industry, snippet FROM cards")
def harvest_cards(spark, d):
    pages = site_pages(spark, d).where("page_id < 0 and page_id > -1000000000")
    return HV.list_cards(pages, selector=CARD_SELECTOR, fallback=CARD_FALLBACK)


@register(
    "harvest_bodies",
    f"""WITH {SITE_SQL.strip()},
s AS (SELECT *, 'The long story of ' || p_name || ', told at length and without haste, ' || p_brand AS t FROM p WHERE k % 7 <> 3)
SELECT k AS page_id, CASE WHEN p_size % 10 <> 0 THEN 'The ' || p_name ELSE '' END AS title,
  CASE k % 5 WHEN 1 THEN t || ' ' || t || ' again' WHEN 2 THEN t WHEN 3 THEN t ELSE '' END AS body FROM s""",
)
def harvest_bodies(spark, d):
    pages = site_pages(spark, d).where("page_id >= 0")  # made of parts that are dealt already
    return HV.detail_fields(pages, dealt=True).select("page_id", "title", "body")


@register(
    "harvest_records",
    f"""WITH {SITE_SQL.strip()},
t AS (SELECT *, 'The long story of ' || p_name || ', told at length and without haste, ' || p_brand AS t FROM p WHERE k % 7 <> 3),
f AS (
  SELECT c.page_id, c.pos, c.url, c.name, c.industry, c.snippet, t.k IS NOT NULL OR c.k IS NULL AS has_detail, c.k IS NULL AS home,
    p_size, p_name, p_brand, t.k,
    CASE t.k % 5 WHEN 0 THEN 'It was ' || p_type || '. one; two' WHEN 1 THEN t || ' ' || t || ' again' WHEN 2 THEN t WHEN 3 THEN t ELSE '' END AS told
  FROM cards c LEFT JOIN t ON t.k = c.k)
SELECT page_id, pos, CASE WHEN home THEN 'Home' WHEN has_detail AND p_size % 10 <> 0 THEN 'The ' || p_name ELSE name END AS company_name,
  CASE WHEN industry <> '' THEN industry WHEN has_detail AND p_size % 5 = 1 THEN p_brand WHEN has_detail THEN 'N/A' ELSE '' END AS industry,
  CASE WHEN k % 4 = 1 THEN '$' || p_size || 'M' ELSE 'N/A' END AS funding_amount,
  CASE WHEN has_detail THEN coalesce(nullif(told, ''), nullif(snippet, ''), 'N/A') ELSE snippet END AS failure_reasons,
  CASE WHEN NOT has_detail THEN 'N/A' WHEN k % 3 = 1 THEN 'sold to ' || p_brand ELSE '{OUTCOME_DEFAULT}' END AS outcome,
  url AS source_url, has_detail FROM f""",
)
def harvest_records(spark, d):
    return HV.harvest_records(site_pages(spark, d), selector=CARD_SELECTOR, fallback=CARD_FALLBACK)


# ---------------------------------------------------------------- H9, H10, H15 (synthesised labelled pages)
def labelled_pages(spark, d):
    p = spread(read(spark, d, "part"))
    s, a, o = F.col("p_size") % 4, F.col("p_size") % 3, F.col("p_partkey") % 4
    ind = (
        F.when(s == 0, F.concat(F.lit("<div><span>Industry</span><span>"), F.col("p_type"), F.lit("</span></div>")))
        .when(s == 1, F.concat(F.lit("<div><p>Sector: "), F.col("p_type"), F.lit("</p></div>")))
        .when(s == 2, F.lit("<div><span>Category</span><span></span></div>"))
        .otherwise(F.lit("<p>No label here.</p>"))
    )
    fund = (
        F.when(a == 0, F.concat(F.lit("<div><b>Funding</b><p>Total of $"), F.format_string("%.2f", F.col("p_retailprice")),
                                F.lit("M so far</p></div>")))
        .when(a == 1, F.concat(F.lit("<p>The team raised $"), F.col("p_size").cast("string"), F.lit("M early.</p>")))
        .otherwise(F.lit("<p>No money talk.</p>"))
    )
    out = (
        F.when(o == 0, F.concat(F.lit("<p>Outcome: acquired in "), (F.col("p_size") + 2000).cast("string"), F.lit("</p>")))
        .when(o == 1, F.concat(F.lit("<p>The firm closed its doors in "), F.col("p_brand"), F.lit(". Then more.</p>")))
        .otherwise(F.lit("<p>Nothing more.</p>"))
    )
    html = F.concat(
        F.lit("<html><head><title>"), F.col("p_name"), F.lit("</title></head><body><h1>"), F.col("p_name"),
        F.lit("</h1>"), ind, fund, out, F.lit("</body></html>"),
    )
    return p.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@register(
    "harvest_labelled_value",
    "SELECT p_partkey AS page_id, CASE WHEN p_size % 4 IN (0, 1) THEN p_type ELSE '' END AS industry FROM part",
)
def harvest_labelled_value(spark, d):
    return HV.tree_fields(labelled_pages(spark, d)).select("page_id", "industry")


@register(
    "harvest_amount",
    """SELECT p_partkey AS page_id, CASE p_size % 3 WHEN 0 THEN '$' || printf('%.2f', p_retailprice) || 'M'
       WHEN 1 THEN '$' || CAST(p_size AS VARCHAR) || 'M' ELSE '' END AS funding FROM part""",
)
def harvest_amount(spark, d):
    return HV.tree_fields(labelled_pages(spark, d)).select("page_id", "funding")


@register(
    "harvest_outcome",
    """SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN 'acquired in ' || CAST(p_size + 2000 AS VARCHAR)
       WHEN 1 THEN 'closed its doors in ' || p_brand || '.' ELSE 'Shut down (details unavailable)' END AS outcome
       FROM part""",
)
def harvest_outcome(spark, d):
    return HV.tree_fields(labelled_pages(spark, d)).select("page_id", "outcome")


# ---------------------------------------------------------------- H11 (rows only)
def section_pages(spark, d):
    """Documents as detail pages: a 'What went wrong' heading over the first
    line, a list of all the other lines, then a heading that ends the
    section. Text is HTML-escaped, as a page generator would."""
    doc = read(spark, d, "documents")

    def esc(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                         F.lit(">"), F.lit("&gt;"))

    lines = F.split(F.col("text"), "\n")
    html = F.concat(
        F.lit("<html><body><h1>Doc</h1><h2>What went wrong</h2><p>"), esc(F.get(lines, 0)), F.lit("</p><ul>"),
        F.array_join(F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.concat(F.lit("<li>"), esc(x), F.lit("</li>"))), ""),
        F.lit("</ul><h2>Afterwards</h2><p>Not part of the section.</p></body></html>"),
    )
    return doc.select(F.col("doc_id").alias("page_id"), html.alias("html"))


SECTION_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
s AS (
  SELECT doc_id, regexp_replace(ls[1], '^\\s+|\\s+$', '', 'g') AS head,
         list_filter(list_transform(list_slice(ls, 2, len(ls)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
                     lambda x: x <> '') AS items
  FROM d)
SELECT doc_id AS page_id, head || ' ' || array_to_string(items, '; ') AS section FROM s"""


@register("harvest_section", SECTION_SQL)
def harvest_section(spark, d):
    return HV.tree_fields(section_pages(spark, d)).select("page_id", "section")
