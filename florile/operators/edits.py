"""Edits as an append-only log: overlay, undo and redo, discard, history.

A log row is (seq, op, id, field, value, cleared). Rows with the same op are one operation. A cleared field is not an absent edit: it
wins over the record with an empty value. Undo and redo are rows too (undo: op names the operation undone), so state is a fold over the log.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, id: str = "id", field: str = "field", seq: str = "seq", value: str = "value") -> DataFrame:
    """The last value of each (id, field). A maximum by seq combines before the shuffle, which a window would not."""
    return log.groupBy(id, field).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def effective(log: DataFrame, undone: DataFrame | None = None) -> DataFrame:
    """The log without operations that were undone (and not redone). undone: (op, seq, redo), the last row of an op decides."""
    if undone is None:
        return log
    state = undone.groupBy("op").agg(F.max_by("redo", "seq").alias("redo")).where(~F.col("redo"))
    return log.join(state, "op", "left_anti")


def undo_last(log: DataFrame, n: int, id: str = "id", op: str = "seq") -> DataFrame:
    """The log without the last n operations of each id."""
    w = Window.partitionBy(id).orderBy(F.col(op).desc())
    return log.withColumn("_back", F.row_number().over(w)).where(F.col("_back") > n).drop("_back")


def discard(log: DataFrame, ids: DataFrame | None = None, id: str = "id") -> DataFrame:
    """The log without the pending edits of ids (column id); without ids, no edit stays. Records then show what is stored."""
    return log.limit(0) if ids is None else log.join(ids.select(F.col("id").alias(id)).distinct(), id, "left_anti")


def rename_rows(plan: DataFrame, id: str, before: str, after: str, op: str, first_seq: int = 0, seq: str | None = None) -> DataFrame:
    """A rename plan as log rows of the field "filename", in one operation: those whose name changes. seq: a column that orders the rows of the log; else first_seq and a whole-number id."""
    changed = plan.where(~F.col(before).eqNullSafe(F.col(after)) & F.col(after).isNotNull())
    return changed.select(F.col(id).alias("id"), F.lit(op).alias("op"), F.lit("filename").alias("field"), F.col(before).alias("before"), F.col(after).alias("value"), _seq(first_seq, id, seq))


def _seq(first: int, id: str, seq: str | None) -> Column:
    return (F.lit(first) + F.col(seq or id)).alias("seq")


def copied(records: DataFrame, id: str, source, fields: list[str]) -> dict[str, str | None]:
    """The values of some fields of one record, as text. One row comes to the driver."""
    row = records.where(F.col(id) == source).select(*[F.col(f).cast("string").alias(f) for f in fields]).first()
    return row.asDict() if row else {}


def paste(targets: DataFrame, id: str, values: dict[str, str | None], op: str, first_seq: int = 0) -> DataFrame:
    """Copied values as log rows for each target, in one operation: (id, op, field, value, seq). Absent values are left out, so they overwrite nothing."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in values.items() if v is not None]) if any(v is not None for v in values.values()) else F.array().cast("array<struct<field:string,value:string>>")
    return targets.select(F.col(id).alias("id"), F.explode(rows).alias("x")).select("id", F.lit(op).alias("op"), "x.field", "x.value", (F.lit(first_seq) + F.col("id")).alias("seq"))


def pasted(targets: DataFrame, source: DataFrame, id: str, fields: list[str], op: str, first_seq: int = 0, seq: str | None = None) -> DataFrame:
    """The values of fields of the one row of source as log rows for each target, in one operation: (id, op, field, value, seq). Without a source row there are none.

    Nothing comes to the driver: of source, one row is joined with the targets.
    """
    rows = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))) for f in fields]))
    one = source.select(F.lit(1).alias("_one"), rows.alias("_rows")).limit(1)
    own = targets.select(F.col(id).alias("id"), _seq(first_seq, id, seq), F.lit(1).alias("_one")).join(F.broadcast(one), "_one")
    return own.select("id", "seq", F.explode("_rows").alias("x")).select("id", F.lit(op).alias("op"), "x.field", "x.value", "seq")


#: The stages at which writing a record can fail, in their order.
STAGES = ("validate", "serialise", "verify", "backup", "commit", "rename")


def with_error(rows: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """rows with error and error_stage, of the first check (stage, reason, condition) that holds; both null where none does. Bad rows stay, as data."""
    for stage, _, _ in checks:
        if stage not in STAGES:
            raise ValueError(f"{stage} is no stage")
    order = sorted(checks, key=lambda c: STAGES.index(c[0]))
    error, at = F.lit(None).cast("string"), F.lit(None).cast("string")
    for stage, reason, holds in reversed(order):
        bad = F.coalesce(holds, F.lit(False))
        error, at = F.when(bad, reason).otherwise(error), F.when(bad, stage).otherwise(at)
    return rows.withColumns({"error": error, "error_stage": at})


def overlay(records: DataFrame, log: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """records with the pending values in place, and dirty. A touched field takes the edit's value, be it null or empty."""
    last = latest(log, "id", "field", "seq", "value").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(F.col("value").alias("v"))))).alias("pending"))
    out = records.join(last.withColumnRenamed("id", id), id, "left")
    kinds = dict(records.dtypes)
    new = {f: F.when(F.coalesce(F.map_contains_key("pending", F.lit(f)), F.lit(False)), F.try_element_at("pending", F.lit(f))["v"].try_cast(kinds[f])).otherwise(F.col(f)) for f in fields}
    return out.withColumns(new).withColumn("dirty", F.col("pending").isNotNull()).drop("pending")


def diff(before: DataFrame, after: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """(id, field, before, after) of what differs between two versions of the records."""
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, F.col(f"b.{id}") == F.col(f"a.{id}"))
    each = [F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("before"), F.col(f"a.{f}").cast("string").alias("after"))) for f in fields]
    return both.select(F.col(f"b.{id}").alias(id), F.explode_outer(F.array_compact(F.array(*each))).alias("c")).where("c IS NOT NULL").select(id, "c.*")


def history(log: DataFrame, by: list[str], order: list[Column], n: int = 300) -> DataFrame:
    """The newest n rows of each group, or of the log."""
    from .order import newest

    return newest(log, by, order, n)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows in place of those of the table with the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def mismatches(expected: DataFrame, found: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """What a read-back differs in from what was written: (id, field, before, after); rows that are missing on a side show as null."""
    e, f = expected.alias("e"), found.alias("f")
    both = e.join(f, F.col(f"e.{id}") == F.col(f"f.{id}"), "full_outer")
    each = [F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"e.{c}").cast("string").alias("before"), F.col(f"f.{c}").cast("string").alias("after"))) for c in fields]
    return both.select(F.coalesce(f"e.{id}", f"f.{id}").alias(id), F.explode_outer(F.array_compact(F.array(*each))).alias("c")).where("c IS NOT NULL").select(id, "c.*")
