"""Named views and smart playlists: conditions over a catalog."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import FLAG, MULTI, NUMBER, Catalog
from .search import any_or_all

WEEK_MS = 7 * 24 * 3600 * 1000


def _has(catalog: Catalog, name: str) -> Column:
    """The field is there: not null, and no empty text or list. A number of 0 is there."""
    if name not in catalog:
        return F.lit(False)
    f = catalog[name]
    if f.kind == NUMBER:
        return f.column.isNotNull()
    if f.kind == FLAG:
        return F.coalesce(f.column, F.lit(False))
    return F.size(f.values()) > 0


def views(catalog: Catalog, now_ms: int) -> dict[str, Column]:
    """The named views. now_ms is given, so that a view is the same whenever it runs."""

    def within(name: str) -> Column:
        return F.coalesce(F.lit(now_ms) - catalog[name].column < WEEK_MS, F.lit(False)) if name in catalog else F.lit(False)

    has = lambda *names: any_or_all([_has(catalog, n) for n in names], "any")
    return {
        "all": F.lit(True),
        "recent": within("added"),
        "modified": within("modified"),
        "favorites": has("writable"),
        "writable": has("writable"),
        "missing-artwork": ~has("hasartwork"),
        "missing-metadata": ~(has("title") & has("artist") & has("album")),
        "errors": has("error"),
        "dirty": has("modifiedflag"),
        "lossless": has("lossless"),
        "lossy": ~has("lossless"),
        "artists": has("artist"),
        "albums": has("album"),
        "genres": has("genre"),
        "years": has("year"),
        "labels": has("label", "publisher"),
        "folders": has("folder"),
    }


def view(catalog: Catalog, name: str, now_ms: int) -> Catalog:
    """An unknown view shows all."""
    return catalog.where(views(catalog, now_ms).get(name, F.lit(True)))


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    value: str


def rule_condition(catalog: Catalog, rule: Rule) -> Column:
    """Numbers that are there compare as numbers; flags hold or not; else = means one of the values, != none of them, orderings any."""
    if rule.field not in catalog:
        return F.lit(rule.op == "!=")
    f = catalog[rule.field]
    if f.kind == FLAG:
        return F.coalesce(f.column, F.lit(False)) == F.lit(rule.value.lower() == "true")
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    if f.kind == NUMBER:
        try:
            n = float(rule.value)
        except ValueError:
            return f.column.isNull() & F.lit(rule.op == "!=")
        return F.coalesce(ops[rule.op](f.column.cast("double"), F.lit(n)), F.lit(rule.op == "!="))
    values = F.transform(f.values() if f.kind == MULTI else F.array_compact(F.array(f.column)), lambda x: F.lower(x))
    want = F.lit(rule.value.lower())
    if rule.op == "=":
        return F.array_contains(values, want)
    if rule.op == "!=":
        return ~F.array_contains(values, want)
    return F.exists(values, lambda x: ops[rule.op](x, want))


def smart_playlist(catalog: Catalog, rules: list[Rule], how: str = "all") -> DataFrame:
    """Without rules, nothing."""
    if not rules:
        return catalog.rows.limit(0)
    return catalog.rows.where(any_or_all([rule_condition(catalog, r) for r in rules], how))
