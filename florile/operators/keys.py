"""Open keys: names that records bring along, of which a few are frequent and any number are rare.

Frequent ones are found without counting all: a sketch of bounded size gives every value with at least the share asked for (and some others),
and those alone are then counted exactly. So a shuffle has at most as many rows for a task as the sketch has entries, however many keys there are.
"""

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of the sketch for each value that can have the share. A sketch of m entries misses no value that is more than 5.25 / m of all.
ENTRIES = 6


def frequent(values: DataFrame, column: str, share: float) -> DataFrame:
    """column and n, its exact number of rows, of the values that make up at least share of all rows with a value. share is at least 0.00001."""
    entries = ceil(ENTRIES / share)
    if not 1e-5 <= share <= 1:
        raise ValueError(f"a share of {share} is not within 0.00001 and 1")
    own = values.select(F.col(column).alias("v")).where("v IS NOT NULL")
    likely = own.agg(F.expr(f"approx_top_k(v, {entries}, {entries})").alias("top")).select(F.explode("top.item").alias("v"))
    counted = own.join(F.broadcast(likely), "v", "left_semi").groupBy("v").agg(F.count("*").alias("n"))  # at most entries rows
    return counted.where(F.col("n") >= F.lit(share) * own.agg(F.count("*")).scalar()).select(F.col("v").alias(column), "n")


def frequent_keys(rows: DataFrame, column: str, share: float = 0.01) -> list[str]:
    """The keys of a map column that make up at least share of all its entries, in their order; at most 1 / share of them."""
    keys = rows.select(F.explode(F.map_keys(column)).alias("key"))
    return sorted(r["key"] for r in frequent(keys, "key", share).collect())


def widened(rows: DataFrame, column: str, keys: list[str], prefix: str = "custom_", rest: str = "rest") -> DataFrame:
    """The map column as a column for each of keys, and all other entries as a JSON text in the order of their keys; null without others.

    A key whose column's name is taken, whatever its case (Spark's names have none), stays in the rest, so nothing is lost.
    """
    taken, wide = {c.lower() for c in rows.columns} | {rest.lower()}, {}
    for k in keys:
        if (name := prefix + k).lower() not in taken:
            taken.add(name.lower())
            wide[k] = F.try_element_at(F.col(f"`{column}`"), F.lit(k)).alias(name)
    entries: Column = F.array_sort(F.map_entries(F.map_filter(F.col(f"`{column}`"), lambda k, _: ~k.isin(list(wide)) if wide else F.lit(True))))
    others = F.when(F.size(entries) > 0, F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != column], *wide.values(), others.alias(rest))
