"""Queries: rescans of changed rows, and saved versions."""

from pyspark.sql import functions as F

from ..operators import edits, snapshots
from ..session import shared_place
from ..sinks import versions
from . import tables


def _pending(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')")
    field = F.when(F.col("event_type") == "purchase", "c_acctbal").otherwise("c_mktsegment")
    return e.select(F.col("user_id").alias("id"), field.alias("field"), F.when(F.col("event_type") == "purchase", F.col("value").cast("string")).otherwise("edited").alias("value"), F.col("event_id").alias("seq"))


def _scanned(spark, sf_dir):
    """Customers as they were at the last scan (some not there yet, some with other balances and segments), as listed now (some gone), and read now."""
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.length("c_name").alias("size"), (F.col("c_custkey") * 10).alias("time"))
    k = F.col("c_custkey")
    index = c.where(k % 10 != 3).withColumns({"c_acctbal": F.when(k % 7 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal")), "time": F.when(k % 7 < 2, F.col("time") - 1).otherwise(F.col("time"))})
    listing = c.where(k % 11 != 5).select("c_custkey", "size", "time")
    return index, listing, lambda todo: todo.join(c.drop("size", "time"), "c_custkey")


def rescan_merge(spark, sf_dir):
    """The index after a rescan with pending edits put over it; conflicts where an edit and the disk have both changed a field."""
    index, listing, read = _scanned(spark, sf_dir)
    log, fields = _pending(spark, sf_dir), ["c_acctbal", "c_mktsegment"]
    new = snapshots.rescan(index, listing, read, "c_custkey", ["size", "time"], fields, log)
    out = edits.overlay(new, log, "c_custkey", fields)
    return out.select("c_custkey", "time", "c_acctbal", "c_mktsegment", "status", F.array_join("conflicts", ",").alias("conflicts"), "dirty")


def rescan_changes(spark, sf_dir):
    index, listing, _ = _scanned(spark, sf_dir)
    return snapshots.changes(index, listing, "c_custkey", ["size", "time"]).groupBy("status").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def saved_versions(spark, sf_dir):
    """The last event of each user and type in four parts, saved as batches; one is tried again with other values, which changes nothing; users with an odd number then get back what they had before the last."""
    place = shared_place(spark, "versions")
    e = tables.read(spark, sf_dir, "events").withColumn("part", F.col("event_id") % 4)
    last = e.groupBy("part", "user_id").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("r")).select("part", "user_id", "r.*")
    schema = last.drop("part").schema
    for n in (0, 1, 2, 1, 3):
        rows = last.where(F.col("part") == n).drop("part")
        versions.commit(rows.withColumn("value", F.lit(-1.0)) if versions.committed(spark, place, n) else rows, place, n, "user_id")
    versions.commit(versions.restored(spark, place, schema, "user_id", last.where("part = 3 AND user_id % 2 = 1"), 3), place, 4, "user_id")
    return versions.state(spark, place, schema, "user_id")


QUERIES = {f.__name__: f for f in (rescan_merge, rescan_changes, saved_versions)}

_STATES = """
WITH c AS (SELECT *, c_custkey AS k, c_custkey % 10 <> 3 AS was, c_custkey % 11 <> 5 AS is_, c_custkey % 7 < 2 AS moved FROM customer),
s AS (SELECT *, CASE WHEN NOT was THEN 'new' WHEN NOT is_ THEN 'gone' WHEN moved THEN 'changed' ELSE 'same' END AS status FROM c WHERE was OR is_)"""
ORACLE = {
    "rescan_changes": _STATES + "SELECT status, count(*) AS n, sum(k)::BIGINT AS keys FROM s GROUP BY 1",
    "rescan_merge": _STATES
    + """, p AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), g AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
SELECT k AS c_custkey, k * 10 - CASE WHEN status = 'gone' AND moved THEN 1 ELSE 0 END AS time, coalesce(p.v, CASE WHEN status IN ('gone', 'same') AND k % 7 = 0 THEN 0.0 ELSE c_acctbal END) AS c_acctbal,
  CASE WHEN g.user_id IS NOT NULL THEN 'edited' ELSE c_mktsegment END AS c_mktsegment, status, CASE WHEN status = 'changed' AND p.user_id IS NOT NULL AND k % 7 = 0 AND c_acctbal <> 0 THEN 'c_acctbal' ELSE '' END AS conflicts,
  p.user_id IS NOT NULL OR g.user_id IS NOT NULL AS dirty
FROM s LEFT JOIN p ON k = p.user_id LEFT JOIN g ON k = g.user_id""",
    "saved_versions": """
WITH l AS (SELECT event_id % 4 AS part, user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2),
b AS (SELECT user_id, part, event_type, value FROM l), e AS (SELECT user_id, max(part) AS top, max(part) FILTER (WHERE part < 3) AS earlier FROM b GROUP BY 1)
SELECT b.user_id, b.event_type, b.value FROM b JOIN e ON b.user_id = e.user_id AND b.part = CASE WHEN e.top = 3 AND b.user_id % 2 = 1 THEN coalesce(earlier, 3) ELSE top END""",
}
