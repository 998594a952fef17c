"""Sorting with a rule for absent values, selections and limits."""

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import MULTI, NUMBER, Catalog

#: Numeric fields whose absence sorts last (ascending); that of others sorts as 0.
LAST = frozenset({"track"})


def sort_key(catalog: Catalog, name: str, collation: str | None = None) -> Column:
    f = catalog[name]
    if f.kind == NUMBER:
        return F.coalesce(f.column.cast("double"), F.lit(sys.float_info.max if f.name in LAST else 0.0))
    text = F.coalesce(F.try_element_at(f.column, F.lit(1)) if f.kind == MULTI else f.column.cast("string"), F.lit(""))
    return F.collate(text, collation) if collation else text


def keys(catalog: Catalog, sort: list[tuple[str, str]], collation: str | None = None) -> list[Column]:
    """Each key in its direction; then the name, always rising; then the order of arrival."""
    own = [k.desc() if way == "desc" else k.asc() for name, way in sort if name in catalog for k in [sort_key(catalog, name, collation)]]
    return [*own, F.col(catalog.name).asc(), F.col(catalog.seq).asc()]


def ordered(catalog: Catalog, sort: list[tuple[str, str]], collation: str | None = None) -> DataFrame:
    """collation "UNICODE" sorts text as people do; without it, text sorts by bytes."""
    return catalog.rows.orderBy(*keys(catalog, sort, collation))


def top(catalog: Catalog, sort: list[tuple[str, str]], n: int) -> DataFrame:
    return ordered(catalog, sort).limit(n)


def slice_rows(catalog: Catalog, sort: list[tuple[str, str]], first: int, count: int) -> DataFrame:
    """Rows first, first + 1, ... of the order, by offset: only the first rows of each task meet."""
    return ordered(catalog, sort).offset(first).limit(count)


def selected(catalog: Catalog, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose id is among ids."""
    return catalog.rows.join(ids.select(F.col(column).alias(catalog.id)).distinct(), catalog.id, "left_semi")


def toggled(catalog: Catalog, chosen: DataFrame, switch: DataFrame) -> DataFrame:
    """Ids that are in exactly one of the two sets."""
    both = chosen.select("id").distinct().withColumn("n", F.lit(1)).unionByName(switch.select("id").distinct().withColumn("n", F.lit(1)))
    return both.groupBy("id").agg(F.sum("n").alias("n")).where("n = 1").select("id")


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group (of all rows where by is empty: a plain top n)."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def between(catalog: Catalog, sort: list[tuple[str, str]], anchor, to) -> DataFrame:
    """The rows from one id to the other in the order, whichever comes first; to alone if either is not there.

    The two rows' keys are looked up (one row comes to the driver), so the range is a filter on the keys and nothing is numbered.
    """
    order = [(sort_key(catalog, n), way) for n, way in sort if n in catalog] + [(F.col(catalog.name), "asc"), (F.col(catalog.seq), "asc")]
    ends = {r[catalog.id]: r for r in catalog.rows.where(F.col(catalog.id).isin(anchor, to)).select(catalog.id, *[k.alias(f"_k{i}") for i, (k, _) in enumerate(order)]).limit(2).collect()}
    if anchor not in ends or to not in ends:
        return catalog.rows.where(F.col(catalog.id) == to)

    def after(end) -> Column:
        """The row stands at or after the end."""
        out = F.lit(True)
        for i in range(len(order) - 1, -1, -1):
            k, way = order[i]
            v = F.lit(end[f"_k{i}"])
            beyond = k > v if way == "asc" else k < v
            out = F.when(beyond, True).when(k.eqNullSafe(v), out).otherwise(False)
        return out

    a, b = ends[anchor], ends[to]
    one = after(a) & (~after(b) | (F.col(catalog.id) == to))
    other = after(b) & (~after(a) | (F.col(catalog.id) == anchor))
    return catalog.rows.where(one | other)
