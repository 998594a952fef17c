"""The search language: words and field clauses, compiled once into a DataFrame condition.

`word`, `"a phrase"`, `field:value`, `field:>=1990`, `-field:value`. Terms are joined by and; AND, OR and NOT as words are dropped.
Default policy: the evident intent of the language; compat=True keeps what the language is known to do: a dash before a plain word
is ignored, and one before a yes-or-no field has no effect. In both, -field:x means "differs from x", not "does not contain x".
"""

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import FLAG, NUMBER, Catalog, Field

OPS = (">=", "<=", "!=", ">", "<", "=", "~")
OPPOSITE = {">": "<=", "<": ">=", ">=": "<", "<=": ">", "=": "!=", "~": "!=", "!=": "!="}


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: object
    negated: bool = False

    def __str__(self) -> str:
        return f"{self.field} {self.op} {self.value}"


@dataclass(frozen=True)
class Query:
    words: tuple[tuple[str, bool], ...]
    clauses: tuple[Clause, ...]


def tokens(text: str) -> list[str]:
    """Split at white space outside quotes; a quote that is not closed runs to the end."""
    return re.findall(r"""(?:[^\s"']|"[^"]*(?:"|$)|'[^']*(?:'|$))+""", text)


def _bare(value: str) -> str:
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _number(text: str) -> float | None:
    try:
        return float(text.strip())
    except ValueError:
        return None


def parse(text: str, catalog: Catalog) -> Query:
    words, clauses = [], []
    for t in tokens(text):
        if t in ("AND", "OR", "NOT"):
            continue
        minus = t.startswith("-") and len(t) > 1
        name, colon, rest = t[minus:].partition(":")
        key = name.lower().partition(".")[0]
        if colon and (name in catalog or key in catalog):
            op = next((o for o in OPS if rest.startswith(o)), "")
            raw = _bare(rest[len(op) :])
            if not raw:
                raise ValueError(f"{name}: a value is missing")
            f = catalog[name if name in catalog else key]
            op = op or "~"
            value: object = raw
            if f.kind == FLAG:
                value = raw.lower() not in ("false", "no", "0")
            elif f.kind == NUMBER and (n := _number(raw)) is not None:
                value = n
            clauses.append(Clause(f.name, OPPOSITE[op] if minus else op, value, minus))
        else:
            words.append((_bare(t[minus:]), minus))
    return Query(tuple(words), tuple(clauses))


def _shown(n: float) -> str:
    return str(int(n)) if n == int(n) else repr(n)


def compare(value: Column, op: str, literal: object) -> Column:
    """One value (a string) against a literal: equality and containment fold case, orderings need numbers on both sides."""
    text = _shown(literal).lower() if isinstance(literal, float) else str(literal).lower()
    if op in ("=", "!="):
        same = F.lower(value) == text
        return same if op == "=" else ~same
    if op == "~":
        return F.contains(F.lower(value), F.lit(text))
    n = literal if isinstance(literal, float) else _number(str(literal))
    if n is None:
        return F.lit(False)
    v = value.try_cast("double")
    return F.coalesce({">": v > n, "<": v < n, ">=": v >= n, "<=": v <= n}[op] & ~F.isnan(v), F.lit(False))


def clause_condition(f: Field, c: Clause, compat: bool = False) -> Column:
    """A field without values satisfies only !=; otherwise any value may satisfy the clause."""
    if f.kind == FLAG:
        on = F.coalesce(f.column.cast("boolean"), F.lit(False))
        return on == F.lit(bool(c.value) != (c.negated and not compat))
    if f.kind == NUMBER and c.op in (">", "<", ">=", "<=") and isinstance(c.value, float):
        # Straight on the column, so that it can be pushed to the scan; 0 counts as absent, and null filters like false.
        n, v = f.column, int(c.value) if c.value == int(c.value) else c.value
        return (n != 0) & {">": n > v, "<": n < v, ">=": n >= v, "<=": n <= v}[c.op]
    if f.kind in ("text", NUMBER):
        there = f.column.isNotNull() & (f.column != (0 if f.kind == NUMBER else ""))
        return F.coalesce(F.when(there, compare(f.column.cast("string"), c.op, c.value)).otherwise(c.op == "!="), F.lit(False))
    values = f.values()
    return F.when(F.size(values) == 0, c.op == "!=").otherwise(F.exists(values, lambda x: compare(x, c.op, c.value)))


def haystack(catalog: Catalog) -> Column:
    return F.lower(F.concat_ws(" ", *(catalog[n].text() for n in catalog.haystack)))


def condition(catalog: Catalog, text: str, compat: bool = False) -> Column:
    """The whole query as one condition."""
    q = parse(text, catalog)
    parts = [clause_condition(catalog[c.field], c, compat) for c in q.clauses]
    if q.words:
        hay = haystack(catalog)
        parts += [~F.contains(hay, F.lit(w.lower())) if minus and not compat else F.contains(hay, F.lit(w.lower())) for w, minus in q.words]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(catalog: Catalog, text: str, sort: list[tuple[str, str]] | None = None, limit: int | None = None, view: Column | None = None, compat: bool = False) -> DataFrame:
    """View, query, order and limit in one plan."""
    from .order import ordered

    where = condition(catalog, text, compat)
    found = catalog.where(where if view is None else view & where)
    out = ordered(found, sort) if sort else found.rows
    return out.limit(limit) if limit is not None else out


def described(c: Clause) -> str:
    """A clause as people read it: "field: value" where it is held within, "field op value" else, with "not" in front where it is negated."""
    shown = _shown(c.value) if isinstance(c.value, float) else str(c.value).lower() if isinstance(c.value, bool) else str(c.value)
    return ("not " if c.negated else "") + (f"{c.field}: {shown}" if c.op == "~" else f"{c.field} {c.op} {shown}")


def clause_counts(catalog: Catalog, text: str, compat: bool = False) -> DataFrame:
    """Which part of a query lets how many rows through: place, clause and n for each clause and word, and for the query as a whole, in one pass."""
    q = parse(text, catalog)
    each = [(described(c), clause_condition(catalog[c.field], c, compat)) for c in q.clauses]
    hay = haystack(catalog) if q.words else None
    each += [(("without " if minus and not compat else "with ") + w.lower(), ~F.contains(hay, F.lit(w.lower())) if minus and not compat else F.contains(hay, F.lit(w.lower()))) for w, minus in q.words]
    each.append(("all", condition(catalog, text, compat)))
    sums = catalog.rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, (_, c) in enumerate(each)])
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("clause"), F.col(f"_{i}").alias("n")) for i, (name, _) in enumerate(each)])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def any_or_all(conditions: list[Column], how: str = "all") -> Column:
    """A group of conditions; an empty group holds."""
    if not conditions:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if how == "all" else (lambda a, b: a | b), conditions)
