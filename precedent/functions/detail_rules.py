"""Rules over flattened pages (functions/dom.py) as Column expressions: each
takes the ``texts`` (and ``elements``) arrays of a page and gives one string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from precedent.functions.jsonx import _bind
from precedent.functions.selectors import first_inside, select

# Label words, amount patterns, section keywords and outcome
# keywords/pattern/default of the detail-page rules, in their order.
INDUSTRY_LABELS = ["Industry", "Sector", "Category", "行业"]
FUNDING_LABELS = ["Funding", "Raised", "Total Raised", "Investment"]
FUNDING_PATTERNS = [
    r"\$[\d,.]+ ?[MBKmillion|billion|thousand]*",
    r"raised .*?\$[\d,.]+[MBK]?",
    r"funding.*?\$[\d,.]+",
]
REASON_KEYWORDS = ["why .* fail", "reason", "cause", "what went wrong", "lesson", "mistake", "postmortem", "post-mortem"]
OUTCOME_KEYWORDS = ["Outcome", "Status", "Result", "What happened", "Shut down", "Acquired"]
OUTCOME_PATTERN = r"(shut ?down|closed|ceased|bankrupt|acquired by|pivoted|dissolved).*?\."
OUTCOME_DEFAULT = "Shut down (details unavailable)"
HEADINGS = ["h1", "h2", "h3", "h4"]
# Where a page's body is, and the parts of a list card.
BODY = "article p, .rich-text p, .w-richtext p, main p"
CARD_HEADING = "h2, h3, h4, [class*='heading'], [class*='name'], [class*='title']"
CARD_INDUSTRY = "[class*='tag'], [class*='category'], [class*='industry']"
CARD_SNIPPET = "p, [class*='description'], [class*='excerpt']"

_FLAGS = "(?iud)"  # any case, Unicode, and only \n ends a line


def _trim(c: Column) -> Column:
    r"""``^\s+|\s+$`` taken away, without a search of the whole text where its end is no
    line separator (before which ``$`` matches too)."""
    def cut(v: Column) -> Column:
        odd = v.endswith("\u0085") | v.endswith("\u2028") | v.endswith("\u2029")
        return F.when(odd, F.regexp_replace(v, r"^\s+|\s+$", "")).otherwise(F.btrim(v, F.lit(" \t\n\x0b\f\r")))

    return _bind(c, cut)


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _joined(texts: Column, lo: Column, hi: Column, sep: str = "", strip: bool = True) -> Column:
    """Texts lo:hi as one string; stripped one by one, empty ones left out."""
    values = F.transform(F.slice(texts, lo + 1, hi - lo), lambda t: _trim(t["value"]) if strip else t["value"])
    return F.array_join(F.filter(values, lambda v: v != "") if strip else values, sep)


def _whole(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t: t["value"]), "")


def page_text(texts: Column) -> Column:
    """All text of a page; ``page`` of the rules."""
    return _whole(texts)


def labelled(texts: Column) -> Column:
    """The texts that hold any label or keyword of any rule, so that each text is
    searched once; ``hits`` of the rules."""
    words = [*INDUSTRY_LABELS, *FUNDING_LABELS, *REASON_KEYWORDS, *OUTCOME_KEYWORDS]
    return F.filter(texts, lambda t: t["value"].rlike(_any(words)))


def _any(words: list[str]) -> str:
    """Pattern of any of the words, which all begin with a plain letter: a place whose
    letter begins none of them is passed over at once."""
    return _FLAGS + f"(?=[{''.join(sorted({w[0] for w in words}))}])(?:{'|'.join(words)})"


def _at_labels(hits: Column, words: list[str], value: Callable[[Column, Column], Column]) -> Column:
    """The first ``value(word, first text that matches the word)`` that is not null, in
    the order of the words; ``value`` gives null for a null text. The texts are searched
    once for all words, words after the one that counts are not looked at, and one
    expression serves all words, so that a rule is built and analysed once."""

    def at(mine: Column, word: Column) -> Column:
        first = F.get(F.filter(mine, lambda t: F.rlike(t["value"], F.concat(F.lit(_FLAGS), word))), F.lit(0))
        return F.array_compact(F.array(_bind(first, lambda t: value(word, t))))

    def search(mine: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.aggregate(F.array(*[F.lit(w) for w in words]), none, lambda told, w: F.when(F.size(told) > 0, told).otherwise(at(mine, w)))

    return F.get(_bind(F.filter(hits, lambda t: t["value"].rlike(_any(words))), search), 0)


def text_of(texts: Column, e: Column) -> Column:
    """Text of an element: its text nodes stripped, empty ones left out, joined; null
    for no element."""
    return F.when(e.isNotNull(), _joined(texts, e["lo"], e["hi"]))


def first_text(texts: Column, elements: Column, tag: str) -> Column:
    """Text of the first element of a kind; '' without one."""
    first = F.get(F.filter(elements, lambda e: e["tag"] == tag), F.lit(0))
    return F.coalesce(_bind(first, lambda e: text_of(texts, e)), F.lit(""))


def title(texts: Column, elements: Column) -> Column:
    """Text of the first h1; '' without one."""
    return first_text(texts, elements, "h1")


def body(texts: Column, elements: Column, least: int, most: int) -> Column:
    """The first ``most`` paragraphs of BODY longer than ``least``, joined by a space."""
    told = F.transform(select(elements, BODY), lambda e: text_of(texts, e))
    return F.array_join(F.slice(F.filter(told, lambda t: F.length(t) > least), 1, most), " ")


def card(texts: Column, elements: Column, e: Column, name_chars: int) -> Column:
    """(href, name, industry, snippet) of a card; '' for what it doesn't have, and its
    own text, cut, for a missing name."""
    part = lambda selector: F.coalesce(_bind(first_inside(elements, e, selector), lambda x: text_of(texts, x)), F.lit(""))
    name = _bind(part(CARD_HEADING), lambda n: F.when(n != "", n).otherwise(F.substring(text_of(texts, e), 1, name_chars)))
    return F.struct(F.coalesce(e["href"], F.lit("")).alias("href"), name.alias("name"), part(CARD_INDUSTRY).alias("industry"),
                    part(CARD_SNIPPET).alias("snippet"))


def labelled_value(texts: Column, hits: Column, preview: Column) -> Column:
    """A set preview value; else, at the first label found, the text of the
    holder's next sibling (even if empty), or the holder's own text without the
    label if anything is left of it."""

    def value(label: Column, t: Column) -> Column:
        own = F.replace(_joined(texts, t["lo"], t["hi"]), label, F.lit(""))
        left = _filled(F.regexp_replace(own, "^[: ]+|[: ]+$", ""))
        return F.when(t["next_lo"].isNotNull(), _joined(texts, t["next_lo"], t["next_hi"])).otherwise(left)

    return F.coalesce(_filled(preview), _at_labels(hits, INDUSTRY_LABELS, value), F.lit(""))


def amount(texts: Column, hits: Column, page: Column) -> Column:
    """First amount pattern in the holder of a label, label by label; else in
    the whole page; else ''."""

    def found(text: Column) -> Column:
        return F.coalesce(*[_filled(F.regexp_extract(text, _FLAGS + p, 0)) for p in FUNDING_PATTERNS])

    def value(_, t: Column) -> Column:
        return F.when(t.isNotNull(), _bind(_joined(texts, t["lo"], t["hi"], strip=False), found))

    return F.coalesce(_trim(F.coalesce(_at_labels(hits, FUNDING_LABELS, value), _bind(page, found))), F.lit(""))


def section(texts: Column, elements: Column, hits: Column) -> Column:
    """Blocks between the heading around the first keyword and the next h1-h4
    beside it: paragraphs as text, list items joined by '; ', all joined by a
    space; '' without any."""

    def blocks(_, t: Column) -> Column:
        head = t["head"]
        parent = F.get(elements, head)["parent"]
        beside = F.filter(elements, lambda e, i: (i > head) & (e["parent"] == parent))
        stop = F.array_position(F.transform(beside, lambda e: e["tag"].isin(HEADINGS)), True)
        upto = F.when(stop > 0, F.slice(beside, F.lit(1), (stop - 1).cast("int"))).otherwise(beside)
        parts = F.transform(
            F.filter(upto, lambda e: e["tag"].isin("p", "ul", "ol")),
            lambda e: F.when(e["tag"] == "p", _joined(texts, e["lo"], e["hi"])).otherwise(
                _joined(texts, e["lo"], e["hi"], "; ")),
        )
        return _bind(parts, lambda told: F.when(F.size(told) > 0, F.array_join(told, " ")))

    return F.coalesce(_at_labels(hits, REASON_KEYWORDS, blocks), F.lit(""))


def outcome(texts: Column, hits: Column, page: Column) -> Column:
    """Text of the holder of the first keyword without that keyword, if anything
    is left; else the closing phrase found in the page; else the default."""

    def value(kw: Column, t: Column) -> Column:
        said = F.concat(F.lit(_FLAGS + "^"), kw, F.lit(r"\s*:?\s*"))
        return _filled(_trim(F.regexp_replace(_joined(texts, t["lo"], t["hi"]), said, "")))

    phrase = _filled(_trim(F.regexp_extract(page, _FLAGS + OUTCOME_PATTERN, 0)))
    return F.coalesce(_at_labels(hits, OUTCOME_KEYWORDS, value), phrase, F.lit(OUTCOME_DEFAULT))
