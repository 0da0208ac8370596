"""Strict JSON-object extraction from model text, as Column expressions.

Spark's ``from_json`` alone is lenient (it accepts trailing text after the
object and single quotes). The strict form used here:
  * the candidate must start with '{' and end with '}' after trimming;
  * it is parsed wrapped in '[...]' as array<map<string,string>> with single
    quotes and NaN/Infinity disabled, and must give exactly one element
    (rejects trailing text and ``{..},{..}``);
  * key presence comes from the map (a JSON null still counts as present);
  * values come from a struct parse, where a duplicate key keeps its last
    value, as Python's parser does.
Values are strings: nested values are compact JSON, booleans 'true'/'false',
JSON null is SQL null (the reference's ``str()`` would give 'None').

Intermediate values are bound once through a one-element ``transform``
(``_bind``), so every parse and regex appears once in the expression tree;
writing them as plain nested Columns repeats subtrees and makes the optimizer
time explode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
_WS = r"[ \t\n\r\f\x0B]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bind(value: Column, fn) -> Column:
    """fn(v) with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), fn), 0)


def strip(t) -> Column:
    """Trim ASCII whitespace on both ends."""
    return F.regexp_replace(_c(t), f"^{_WS}+|{_WS}+$", "")


def blank_to_null(t) -> Column:
    return _bind(_c(t), lambda c: F.when(c.isNotNull() & (strip(c) != ""), c))


def unfence_anchored(t) -> Column:
    """Drop a leading ```/```json fence and a trailing ``` fence, trim, and drop
    trailing commas before '}' or ']' (anywhere, strings included)."""
    x = F.regexp_replace(_c(t), r"^```(?:json)?\s*", "")
    x = F.regexp_replace(x, r"\s*```$", "")
    x = strip(x)
    return F.regexp_replace(x, r",\s*([}\]])", "$1")


def unfence_lines(t) -> Column:
    """When the trimmed text starts with a fence, drop every line whose
    trimmed form starts with ```; then trim."""
    def body(x):
        lines = F.filter(F.split(x, "\n"), lambda l: ~strip(l).startswith("```"))
        return strip(F.when(x.startswith("```"), F.array_join(lines, "\n")).otherwise(x))

    return _bind(strip(t), body)


def object_keys(t) -> Column:
    """map<string,string> of a strict single JSON object, else null."""
    def body(c):
        arr = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<map<string,string>>", _OPTS)
        return _bind(arr, lambda a: F.when(c.startswith("{") & c.endswith("}") & (F.size(a) == 1), F.get(a, 0)))

    return _bind(_c(t), body)


def _values_parse(c: Column, fields: list[str]) -> Column:
    ddl = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    return F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), ddl, _OPTS), 0)


def object_values(t, fields: list[str]) -> Column:
    """struct of ``fields`` (strings) of a strict single JSON object, else null."""
    return _bind(_c(t), lambda c: F.when(object_keys(c).isNotNull(), _values_parse(c, fields)))


def has_keys(m: Column, required: list[str]) -> Column:
    cond = F.lit(True)
    for k in required:
        cond = cond & F.map_contains_key(m, F.lit(k))
    return F.coalesce(m.isNotNull() & cond, F.lit(False))


def extract_object(t, required: list[str]) -> Column:
    """Strict extraction: the first candidate that parses to an object holding
    all ``required`` keys; struct of the required fields, or null. Candidates,
    in order: the whole trimmed text, the first flat {...} block, the greedy
    first-'{'-to-last-'}' span; a later one is only built and parsed when the
    earlier ones failed."""
    def attempt(cand: Column, rest) -> Column:
        def on_text(u):
            return _bind(object_keys(u), lambda m: F.when(has_keys(m, required), _values_parse(u, required))
                         .otherwise(rest() if rest else F.lit(None)))
        return _bind(unfence_anchored(cand), on_text)

    def per_text(x):
        c2 = lambda: attempt(F.regexp_extract(x, r"(?s)\{.*\}", 0), None)
        c1 = lambda: attempt(F.regexp_extract(x, r"\{[^{}]*\}", 0), c2)
        return attempt(x, c1)

    return _bind(strip(blank_to_null(t)), lambda x: F.when(x.isNotNull(), per_text(x)))


def extract_lenient(t, fields: list[str]) -> Column:
    """Fence-line stripping then a plain parse: struct<keys map, values
    struct>, both null unless the text is one JSON object (a list or scalar
    counts as a failure downstream)."""
    def body(u):
        return _bind(object_keys(u), lambda m: F.struct(
            m.alias("keys"), F.when(m.isNotNull(), _values_parse(u, fields)).alias("values")
        ))

    return _bind(unfence_lines(t), body)
