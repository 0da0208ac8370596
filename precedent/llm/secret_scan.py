"""Secrets in texts: certain spans by pattern, and weak parts linked to credentials.

Three certain kinds are always reported: assigned secrets, access keys and long
hexadecimal strings. A credential often comes in parts of which none is certain
alone: an identifier (``user = ...``), a secret under a looser name (``key:
...``), an endpoint (a service address). Such weak candidates are found by
pattern and linked by an interval join: a part's scope is its span widened by
``scope`` code points on both sides, and parts meet where scopes overlap. An
identifier is reported if a secret (weak or certain) lies in its scope, a weak
secret if an identifier (weak, or an access key) does, an endpoint if both do.
A weak candidate that overlaps a certain span is no part.

Native: DataFrame functions only. One pass over the texts keeps the lengths of
matches and of the gaps between them; offsets are running sums per (row, kind),
and the interval join's keys are (row, bin of ``scope`` code points), so that a
text with very many parts is dealt out by its bins and no bin holds more parts
than fit into ``scope`` code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precedent.llm.common import save

#: Code points on both sides of a part in which the other parts are looked for.
SCOPE = 200
#: The kinds, in the order in which spans with one start are listed.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
_CERTAIN = 3
_MATCHES = "array<struct<kind int, i int, gap int, len int, ok boolean>>"


def any_case(words: str) -> str:
    """Each ASCII letter in either case; the rest of the pattern as it is."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() and c.isascii() else c for c in words)


_EQUALS = r"""["']?\x20*[:=]\x20*["']?"""
_ACCOUNT = any_case("client_?id|access_?key_?id|account_?id|account|user_?name|user|login")
_LOOSE = any_case("key|pwd|pass|auth|credential|signature")
_SCHEMES = any_case("https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqps?|s3|ldaps?")
#: Each kind's pattern, written so that Java and RE2 read it alike. A minimal
#: length stands in the pattern where a shorter match can hide no longer one;
#: that of assigned values doesn't, see SHORTEST.
PATTERNS = {
    "assign": f"({any_case('password|passwd|secret|token|api_?key')}){_EQUALS}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "identifier": f"({_ACCOUNT}){_EQUALS}([A-Za-z0-9@._-]{{3,}})",
    "secret": f"({_LOOSE})[A-Za-z_]{{0,16}}{_EQUALS}([A-Za-z0-9+/_.=-]{{6,}})",
    "endpoint": rf"""({_SCHEMES})://[^\x00-\x20"'<>]+""",
}
#: What every match of a kind contains.
_NEEDS = {"access": "AKIA", "endpoint": "://"}
#: Code points that an assigned value has at least. A shorter match is dropped,
#: after it has taken its place among the matches that do not overlap.
SHORTEST = 6


def _matches(text: Column, kind: int) -> Column:
    """array<struct<kind, i, gap, len, ok>>: the length of each match of a kind and of
    the text between it and the one before."""
    pattern, needs = PATTERNS[KINDS[kind]], _NEEDS.get(KINDS[kind])
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    ok = lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= SHORTEST if KINDS[kind] == "assign" else F.lit(True)
    each = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"),
        ok(x["m"]).alias("ok")))
    # most texts hold no match: they are searched once, and not at all where a fixed part is missing
    some = text.rlike(pattern)
    return F.when(text.contains(needs) & some if needs else some, each).otherwise(F.array().cast(_MATCHES))


def _bins(start: Column, end: Column, scope: int) -> Column:
    return F.explode(F.sequence(F.floor(start / scope), F.floor(end / scope)))


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted structs (start, kind, end), comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """The rows (row, id), one per input row, and the spans (row, kind, start, end)
    that are reported: the certain ones and the linked weak ones."""
    if scope < 1:
        raise ValueError("scope must be at least 1")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    found = F.concat(*[_matches(F.col("t"), k) for k in range(len(KINDS))])
    rows = save(src.select(F.monotonically_increasing_id().alias("row"), "id", found.alias("m")), "secret-matches")
    each = rows.select("row", F.inline("m"))
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(so_far)
    spans = each.withColumn("end", end).where("ok").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    spans = save(spans, "secret-spans")
    certain, weak = spans.where(F.col("kind") < _CERTAIN), spans.where(F.col("kind") >= _CERTAIN)

    near = weak.withColumn("bin", _bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope, scope))
    part = spans.select("row", F.col("kind").alias("p_kind"), F.col("start").alias("p_start"), F.col("end").alias("p_end"),
                        _bins(F.col("start"), F.col("end"), scope).alias("bin"))
    meet = (F.col("p_start") <= F.col("end") + scope) & (F.col("start") <= F.col("p_end") + scope)
    over = (F.col("p_start") < F.col("end")) & (F.col("start") < F.col("p_end"))
    # a weak candidate that lies over a certain span is no part, neither to be reported nor to support another
    hidden = near.join(part.where(F.col("p_kind") < _CERTAIN), ["row", "bin"]).where(over).select("row", "kind", "start").distinct()
    shown = save(weak.join(hidden, ["row", "kind", "start"], "left_anti"), "secret-weak")
    near = shown.withColumn("bin", _bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope, scope))
    part = certain.unionByName(shown).select(
        "row", F.col("kind").alias("p_kind"), F.col("start").alias("p_start"), F.col("end").alias("p_end"),
        _bins(F.col("start"), F.col("end"), scope).alias("bin"))
    names = {k: i for i, k in enumerate(KINDS)}
    is_id = F.col("p_kind").isin(names["access"], names["identifier"])
    is_secret = F.col("p_kind").isin(names["assign"], names["hex"], names["secret"])
    links = near.join(part, ["row", "bin"]).where(meet & ~(over & (F.col("kind") == F.col("p_kind"))))
    links = links.groupBy("row", "kind", "start", "end").agg(F.max(is_id).alias("an_id"), F.max(is_secret).alias("a_secret"))
    linked = links.where(
        ((F.col("kind") == names["identifier"]) & F.col("a_secret"))
        | ((F.col("kind") == names["secret"]) & F.col("an_id"))
        | ((F.col("kind") == names["endpoint"]) & F.col("an_id") & F.col("a_secret")))
    return rows.select("row", "id"), certain.unionByName(linked.select("row", "kind", "start", "end"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_linked (weak parts
    reported), base_sha256 (of the certain spans as kind:start:end by start, then
    kind, comma-joined), spans (all spans, written alike; offsets count code
    points and the end is exclusive).

    A null or empty text has no spans; rows with a null id or one that repeats are
    scanned each by itself; other columns are not read; an empty table gives an
    empty result."""
    rows, spans = find_spans(docs, id_col, text_col, scope)
    at = F.struct("start", "kind", "end")
    count = lambda k: F.count_if(F.col("kind") == KINDS.index(k)).alias(f"n_{k}")
    every = spans.groupBy("row").agg(
        *[count(k) for k in KINDS[:_CERTAIN]], F.count_if(F.col("kind") >= _CERTAIN).alias("n_linked"),
        F.sort_array(F.collect_list(at)).alias("s"))
    base = _listed(F.filter("s", lambda x: x["kind"] < _CERTAIN))
    every = every.select("row", "n_assign", "n_access", "n_hex", "n_linked", base.alias("base"), _listed(F.col("s")).alias("spans"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(every, "row", "left").select(
        F.col("id").alias("doc_id"), zero("n_assign"), zero("n_access"), zero("n_hex"), zero("n_linked"),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
