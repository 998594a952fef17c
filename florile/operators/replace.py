"""Find and replace, action steps and batch edits: expressions that rewrite fields, with hit counts."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import first_year, leading_number, trim


class BadPattern(ValueError):
    """The pattern or its replacement can't be used; said before a plan is made."""


def pattern(find: str, regex: bool = False, ignore_case: bool = True) -> str:
    if regex:
        try:
            re.compile(find)
        except re.error as e:
            raise BadPattern(str(e)) from e
    own = find if regex else "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in find)
    return ("(?i)" if ignore_case else "") + own


def replacement(with_: str, find: str, regex: bool = False) -> str:
    """Only $n of a pattern is special. A group that the pattern lacks is an error here rather than while rows are read."""
    if not regex:
        return with_.replace("\\", "\\\\").replace("$", "\\$")
    groups = re.compile(find).groups
    for n in re.findall(r"\$(\d+)", with_):
        if int(n) > groups:
            raise BadPattern(f"there is no group {n}")
    return re.sub(r"\$(?!\d)", r"\\$", with_.replace("\\", "\\\\"))


def replaced(c: Column, find: str, with_: str, regex: bool = False, ignore_case: bool = True, once: bool = False, whole: bool = False) -> Column:
    """once: the first hit alone. whole: only where the whole value matches. An empty find changes nothing."""
    if not find:
        return c
    p, r = pattern(find, regex, ignore_case), replacement(with_, find, regex)
    if whole:
        flag, body = ("(?i)", p[4:]) if p.startswith("(?i)") else ("", p)
        return F.regexp_replace(c, f"{flag}^(?:{body})$", r)
    if once:
        flag, body = ("(?i)", p[4:]) if p.startswith("(?i)") else ("", p)
        shifted = re.sub(r"(?<!\\)\$(\d+)", lambda m: f"${int(m[1]) + 1}", r)
        return F.regexp_replace(c, f"{flag}(?s)^(.*?)(?:{body})", "$1" + shifted)
    return F.regexp_replace(c, p, r)


def hits(c: Column, find: str, regex: bool = False, ignore_case: bool = True) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern(find, regex, ignore_case))), F.lit(0)) if find else F.lit(0)


def split_values(c: Column, separators: str = ";/") -> Column:
    """A cell of a batch edit as a list: split, trimmed, without blanks."""
    parts = F.split(c, f"[{re.escape(separators)}]")
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def strip_featured(c: Column) -> Column:
    """The artist without whom it features."""
    return F.regexp_replace(c, r"(?i)(?<!\s)\s*+[(\[]?\s*+(?:featuring|feat|ft|with)\.?\s.*$", "")


def track_from_name(name: Column) -> Column:
    return leading_number(name)


def date_in_style(date: Column, style: str = "year") -> Column:
    year = first_year(date)
    forms = {"year": "%04d", "month": "%04d-01", "day": "%04d-01-01"}
    return F.when(year.isNotNull(), F.format_string(forms[style], year))


def empty_fields(fields: list[str]) -> Column:
    """Names of the fields that hold blanks only."""
    return F.array_compact(F.array(*[F.when(trim(F.col(f).cast("string")) == "", F.lit(f)) for f in fields]))
