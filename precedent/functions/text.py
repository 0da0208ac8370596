"""String Column expressions shared by several operators (all JVM-side)."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def between_markers(text, start: str, end: str) -> Column:
    """Substring after the first ``start`` up to the first ``end``; the whole
    text when either marker is missing. The end marker is searched from the
    start of the string, so an end before the start yields ''."""
    t = _c(text)
    s = F.locate(start, t)
    e = F.locate(end, t)
    begin = s + F.lit(len(start))
    length = F.greatest(F.lit(0), e - begin)
    return F.when((s > 0) & (e > 0), F.substring(t, begin, length)).otherwise(t)


def truncate_marked(text, n: int = 800, mark: str = "...") -> Column:
    """Cut to ``n`` characters and append ``mark`` when longer than ``n``."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(mark))).otherwise(t)


def blank_to_null(text) -> Column:
    """'' or whitespace-only -> null."""
    t = _c(text)
    return F.when(~t.rlike(r"^\s*$"), t)


def pad2(n) -> Column:
    """Zero-pad to width 2 without truncating wider numbers."""
    x = _c(n)
    return F.when(x < 10, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))


def subject_tag(name, width: int = 20) -> Column:
    """'#' + upper-case name, whitespace runs to '_', first ``width`` chars, '-CASE'."""
    t = F.regexp_replace(F.upper(_c(name)), r"\s+", "_")
    return F.concat(F.lit("#"), F.substring(t, 1, width), F.lit("-CASE"))


def nonblank_lines(text) -> Column:
    """Lines of a text (split on newline) that are not blank, untrimmed."""
    return F.filter(F.split(_c(text), "\n"), lambda x: ~x.rlike(r"^\s*$"))


def fill(template: str, fields: dict[str, Column]) -> Column:
    """A template with its ``{name}`` places filled from Columns (null reads
    ''); ``{{`` and ``}}`` are braces. A place without a field is refused."""
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is not None:
            if name not in fields:
                raise ValueError(f"no field for the place {{{name}}}; there are {sorted(fields)}")
            pieces.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(F.lit(""), *pieces)
