"""Regex-based HTML Column expressions (JVM-side).

Patterns avoid look-around and back-references so the same text runs under
Java regex (Spark) and RE2 (the DuckDB oracle). Paragraphs close implicitly
at the next <p> or at the end of the enclosing section, as an HTML5 parser
would; text of an element is its markup with tags removed, entities decoded
and the ends trimmed.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from precedent.functions.jsonx import _bind

#: A character reference: decimal, hexadecimal, or a name, with or without its end.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names without an end are at most so long.
_BARE = max(len(k) for k in html5 if not k.endswith(";"))
NOISE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"
WS = r"[ \t\n\r\f]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_noise(html) -> Column:
    """Drop script and style elements and comments."""
    return F.regexp_replace(_c(html), NOISE, "")


def _char(point: Column) -> Column:
    """The character that a numeric reference stands for: Windows-1252 below 160, none
    for control characters and non-characters, U+FFFD for what is no code point."""
    old = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
    known = F.get(F.from_json(F.lit(json.dumps([old.get(n) for n in range(160)])), "array<string>"), point.cast("int"))
    none = ((point < 32) & ~point.isin(9, 10, 12)) | (point == 127) | point.between(0xFDD0, 0xFDEF) | (F.pmod(point, F.lit(65536)) >= 65534)
    utf = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    wrong = point.between(0xD800, 0xDFFF) | (point > 0x10FFFF)
    return F.when((point < 160) & known.isNotNull(), known).when(wrong, F.lit("\ufffd")).when(none, F.lit("")).otherwise(utf)


def _names(end: bool) -> dict[str, dict[str, str]]:
    """Names (two characters or more) with or without an end and what they stand for,
    by their first two characters: a map is searched from its front."""
    out: dict[str, dict[str, str]] = {}
    for name, means in html5.items():
        if name.endswith(";") == end:
            out.setdefault(name[:2], {})[name] = means
    return out


def _decoded(ref: Column) -> Column:
    """What one reference stands for: itself, if it means nothing."""
    name = F.substring(ref, 2, 33)
    named = lambda end: F.element_at(F.from_json(F.lit(json.dumps(_names(end))), "map<string,map<string,string>>"), F.substring(name, 1, 2))
    # without its end a name may go on: the longest start that is a name counts
    start = _bind(named(False), lambda bare: F.when(bare.isNotNull(), F.coalesce(*[
        F.concat(F.element_at(bare, F.substring(name, 1, n)), F.substring(name, n + 1, 33)) for n in range(_BARE, 1, -1)])))
    number = lambda pattern: F.ltrim(F.regexp_extract(ref, pattern, 1), F.lit("0"))
    point = lambda digits, base: F.when(F.length(digits) > 8, F.lit(1 << 32)).otherwise(
        F.coalesce(F.conv(digits, base, 10).cast("long"), F.lit(0)))
    return F.when(ref.rlike("^&#[xX]"), _char(point(number("^&#[xX]([0-9a-fA-F]+)"), 16))).when(
        ref.startswith("&#"), _char(point(number("^&#([0-9]+)"), 10))).otherwise(
        F.coalesce(F.element_at(named(True), name), start, ref))


def unescape(text) -> Column:
    """All named and numeric character references decoded, each once, as a browser
    (and the tree path's parser) reads them."""
    t = _c(text)
    found = F.regexp_extract_all(t, F.lit(REFERENCE), 0)
    parts = _bind(found, lambda refs: F.transform(F.split(t, REFERENCE, -1), lambda gap, i: F.concat(
        gap, F.coalesce(_bind(F.get(refs, i), _decoded), F.lit("")))))
    return F.when(t.contains("&"), F.array_join(parts, "")).otherwise(t)


def trim_ws(text) -> Column:
    return F.regexp_replace(_c(text), f"^{WS}+|{WS}+$", "")


def text_of(fragment) -> Column:
    """Visible text of a fragment: tags removed, entities decoded, trimmed."""
    return trim_ws(unescape(F.regexp_replace(_c(fragment), TAG, "")))


def visible_text(html) -> Column:
    """Page text without script/style/comments; text nodes concatenated."""
    return unescape(F.regexp_replace(strip_noise(html), TAG, ""))


def first_inner(html, tag: str) -> Column:
    """Inner markup of the first <tag> element ('' when absent)."""
    return F.regexp_extract(_c(html), f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1)


def paragraphs(section) -> Column:
    """Texts of the <p> elements of a fragment (implicit close at the next
    <p>), in document order."""
    s = F.regexp_replace(_c(section), r"(?i)</p>", "")
    chunks = F.split(s, r"(?i)<p(?:\s[^>]*)?>")
    return F.transform(F.slice(chunks, 2, 1 << 30), lambda x: text_of(x))


def anchors(html) -> Column:
    """array<struct<href, inner>> of the <a href="..."> elements: the page is searched
    once, the parts are taken from what was found."""
    pat = r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    found = F.regexp_extract_all(_c(html), F.lit(pat), 0)
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, pat, 1).alias("href"), F.regexp_extract(a, pat, 2).alias("inner")))
