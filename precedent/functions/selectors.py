"""Element selectors as array predicates over flattened pages (functions/dom.py).

A selector is a list of alternatives separated by commas; an alternative is a chain
of compounds that enclose each other (``outer inner``), and a compound is a tag,
class tokens and attribute tests in any number: ``a.card[href*='/case/']``. Tests
are ``[name]`` and ``[name=v]``, ``~=``, ``^=``, ``$=``, ``*=`` on class and href,
the attributes that a flattened page keeps. Elements come out in document order,
each once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from precedent.functions.jsonx import _bind

#: Attributes in the element table and their fields.
ATTRIBUTES = {"class": "cls", "href": "href"}
_SPACE = r"[ \t\n\r\f]+"
_COMPOUND = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)?(?P<tests>(?:\.[\w-]+|\[[^\]]*\])*)")
_TEST = re.compile(r"""\.(?P<token>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<quote>["']?)(?P<value>[^"'\]]*)(?P=quote)\s*)?\]""")


@dataclass(frozen=True)
class Compound:
    tag: str | None
    tests: tuple[tuple[str, str, str], ...]  # attribute, operator ('' for presence), value


def _compound(text: str) -> Compound:
    m = _COMPOUND.fullmatch(text)
    if not m or not text:
        raise ValueError(f"not a selector: {text!r}")
    tests = []
    for t in _TEST.finditer(m["tests"]):
        name = "class" if t["token"] else t["name"].lower()
        if name not in ATTRIBUTES:
            raise ValueError(f"pages keep no attribute {name!r}")
        tests.append((name, "~=" if t["token"] else t["op"] or "", t["token"] or t["value"] or ""))
    if sum(len(t[0]) for t in _TEST.finditer(m["tests"])) != len(m["tests"]):
        raise ValueError(f"not a selector: {text!r}")
    return Compound(None if m["tag"] in (None, "*") else m["tag"].lower(), tuple(tests))


def parse(selector: str) -> list[list[Compound]]:
    """Alternatives, each the compounds of a chain from the outermost in."""
    outside = r"(?=(?:[^\[\]]*\[[^\]]*\])*[^\[\]]*$)"  # not inside an attribute test
    return [[_compound(c) for c in re.split(rf"\s+{outside}", alt.strip())] for alt in re.split(rf",{outside}", selector)]


def _test(value: Column, op: str, wanted: str) -> Column:
    w = F.lit(wanted)
    if op == "":
        return value.isNotNull()
    if op == "=":
        return value == w
    if op == "~=":
        return F.array_contains(F.split(value, _SPACE), w)
    if not wanted:  # as in CSS, an empty part is in nothing
        return F.lit(False)
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[op](w)


def matches(compound: Compound, e: Column) -> Column:
    """Whether an element meets a compound."""
    tests = [F.coalesce(_test(e[ATTRIBUTES[name]], op, value), F.lit(False)) for name, op, value in compound.tests]
    if compound.tag is not None:
        tests.insert(0, e["tag"] == compound.tag)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _inside(outer: Column, e: Column) -> Column:
    return F.exists(outer, lambda o: (o["at"] < e["at"]) & (e["at"] < o["end"]))


def _outer(elements: Column, chain: list[Compound]) -> Column:
    """Elements that meet a chain, each level found once."""
    def inside(found: Column, compound: Compound) -> Column:
        return _bind(found, lambda outer: F.filter(elements, lambda e: matches(compound, e) & _inside(outer, e)))

    return reduce(inside, chain[1:], F.filter(elements, lambda e: matches(chain[0], e)))


def select(elements: Column, selector: str) -> Column:
    """The elements that meet a selector."""
    alternatives = parse(selector)
    chains = [a[:-1] for a in alternatives]
    outer = F.struct(F.lit(0).alias("none"), *[_outer(elements, c).alias(f"c{i}") for i, c in enumerate(chains) if c])

    def any_of(found: Column, e: Column) -> Column:
        each = [matches(a[-1], e) & (_inside(found[f"c{i}"], e) if chains[i] else F.lit(True)) for i, a in enumerate(alternatives)]
        return reduce(lambda a, b: a | b, each)

    return _bind(outer, lambda found: F.filter(elements, lambda e: any_of(found, e)))


def first_inside(elements: Column, e: Column, selector: str) -> Column:
    """The first element inside ``e`` that meets a selector of single compounds; null
    without one."""
    alternatives = parse(selector)
    if any(len(a) > 1 for a in alternatives):
        raise ValueError("only single compounds are looked for inside an element")
    within = F.slice(elements, e["at"] + 2, e["end"] - e["at"] - 1)  # descendants lie together
    return F.get(F.filter(within, lambda x: reduce(lambda a, b: a | b, [matches(a[0], x) for a in alternatives])), 0)
