"""Rescans: what changed between two listings, reading only that, and one state of disk, index and pending edits.

An index is the state of the last scan: one row for each id with the stamps (size, time) that it had and the fields that were read. A listing has
ids and stamps alone, which are cheap to get. Rows whose stamps are those of the index keep what the index has; only new and changed
ones are read. Rows that are gone stay as tombstones, so that their pending edits are not lost. An edit wins over what is read; where
the field was changed on disk as well since the edit's base, the row says so in conflicts.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import edits

NEW, CHANGED, SAME, GONE = "new", "changed", "same", "gone"


def changes(index: DataFrame, listing: DataFrame, id: str, stamps: list[str]) -> DataFrame:
    """id and status (new, changed, same, gone) of each id of the two; a tombstone of the index that is listed again is new. Stamps that are null on both sides are equal."""
    alive = index.where("status <> 'gone'") if "status" in index.columns else index
    old = alive.select(F.col(id), F.lit(1).alias("_old"), *[F.col(s).alias(f"_{s}") for s in stamps])
    both = old.join(listing.select(id, F.lit(1).alias("_now"), *stamps), id, "full_outer")
    same = F.lit(True)
    for s in stamps:
        same &= F.col(s).eqNullSafe(F.col(f"_{s}"))
    return both.select(id, F.when(F.col("_old").isNull(), NEW).when(F.col("_now").isNull(), GONE).when(same, SAME).otherwise(CHANGED).alias("status"))


def rescan(index: DataFrame, listing: DataFrame, read: Callable[[DataFrame], DataFrame], id: str, stamps: list[str], fields: list[str], log: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """The new index: id, stamps, fields, status and conflicts (names of fields that an edit and the disk have both changed).

    read: rows of id, stamps and fields for the new and changed rows of the listing, and for no others. log: pending edits (id, field, value, seq),
    whose values are not put in here (edits.overlay does that), but say where conflicts are. seen: counts what is read, as n.
    """
    status = changes(index, listing, id, stamps)
    todo = listing.join(status.where(F.col("status").isin(NEW, CHANGED)), id)
    fresh = read(todo).select(id, *stamps, *fields, "status")
    fresh = fresh.observe(seen, F.count("*").alias("n")) if seen else fresh
    gone = index.where("status = 'gone'").join(listing.select(id), id, "left_anti") if "status" in index.columns else index.limit(0)
    kept = index.drop("status", "conflicts").join(status.where(F.col("status").isin(SAME, GONE)), id)
    kept = kept.select(id, *stamps, *fields, "status").unionByName(gone.select(id, *stamps, *fields, F.lit(GONE).alias("status")))
    if log is None:
        return kept.unionByName(fresh).withColumn("conflicts", F.array().cast("array<string>"))
    pending = edits.latest(log, "id", "field", "seq", "value").where(F.col("field").isin(fields)).groupBy(F.col("id").alias(id)).agg(F.array_sort(F.collect_list("field")).alias("pending"))  # a row for each field at most
    base = index.select(id, *[F.col(f).alias(f"_{f}") for f in fields])
    met = fresh.join(pending, id, "left").join(base, id, "left")
    both = F.array_compact(F.array(*[F.when(F.array_contains("pending", f) & (F.col("status") == CHANGED) & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    fresh = met.select(id, *stamps, *fields, "status", F.coalesce(both, F.array().cast("array<string>")).alias("conflicts"))
    return kept.withColumn("conflicts", F.array().cast("array<string>")).unionByName(fresh)
