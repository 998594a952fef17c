"""Queries: edit log, overlay, undo, history, JSON, streams."""

from pyspark.sql import functions as F

from ..functions import text as _text
from ..operators import edits
from ..session import shared_place
from ..streaming import edit_log
from . import tables


def _log(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"), "value", "ts")


def edit_latest(spark, sf_dir):
    return edits.latest(_log(spark, sf_dir)).select("id", "field", "value", "seq")


def edit_overlay(spark, sf_dir):
    """Customers with pending edits of their balance (from purchases) and segment (from signups) in place."""
    log = _log(spark, sf_dir).where("field IN ('purchase', 'signup')")
    log = log.select("id", F.when(F.col("field") == "purchase", "c_acctbal").otherwise("c_mktsegment").alias("field"), "seq", F.col("value").cast("string").alias("value"))
    out = edits.overlay(tables.read(spark, sf_dir, "customer"), log, "c_custkey", ["c_acctbal", "c_mktsegment"])
    return out.select("c_custkey", "c_acctbal", F.when(F.col("dirty") & F.col("c_mktsegment").rlike("^[0-9.]+$"), "edited").otherwise(F.col("c_mktsegment")).alias("segment"), "dirty")


def edit_diff(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    log = _log(spark, sf_dir).where("field = 'purchase'").select("id", F.lit("c_acctbal").alias("field"), "seq", F.lit("0.5").alias("value"))
    after = edits.overlay(c, log, "c_custkey", ["c_acctbal"]).drop("dirty")
    return edits.diff(c, after, "c_custkey", ["c_acctbal", "c_mktsegment"]).select("c_custkey", "field", "after")


def edit_undo_n(spark, sf_dir):
    return edits.latest(edits.undo_last(_log(spark, sf_dir), 3)).select("id", "field", "value", "seq")


def edit_undone(spark, sf_dir):
    """Operations (one for each hour and user) that were undone by an error event with the same key, unless one came later."""
    log = _log(spark, sf_dir).withColumn("op", F.concat_ws("/", F.col("id"), F.date_trunc("day", "ts").cast("string")))
    undone = log.where("field IN ('error', 'signup')").select("op", "seq", (F.col("field") == "signup").alias("redo"))
    return edits.effective(log.where("field = 'click'"), undone).select("id", "seq")


def edit_history_cap(spark, sf_dir):
    return edits.history(_log(spark, sf_dir), ["id"], [F.col("seq").desc()], 5).select("id", "seq", "field")


def edit_history(spark, sf_dir):
    return edits.history(_log(spark, sf_dir), [], [F.col("ts").desc(), F.col("seq").desc()], 300).select("id", "seq")


def edit_upsert(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    new = e.where("event_type = 'error'").withColumn("value", F.lit(0.0))
    return edits.upsert(e, new, "event_id")


def read_back(spark, sf_dir):
    """What a second version of the nations, one short and one renamed, differs in."""
    n = tables.read(spark, sf_dir, "nation")
    other = n.where("n_nationkey <> 3").withColumn("n_name", F.when(F.col("n_nationkey") == 5, F.lower("n_name")).otherwise(F.col("n_name")))
    return edits.mismatches(n, other, "n_nationkey", ["n_name", "n_regionkey"])


def json_props(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select("event_id", F.try_element_at("m", F.lit("k")).try_cast("long").alias("k"), F.to_json(F.struct("event_id", F.col("event_type").alias("type"))).alias("json"))


def _stream(spark, sf_dir):
    schema = tables.read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _drained(spark, stream, name, mode="append"):
    """The rows that a stream wrote by the time it had read all there is."""
    place = shared_place(spark, name)
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start(f"{place}/rows") if mode == "append" else edit_log.publish(stream, lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{place}/rows"), f"{place}/log")
    q.awaitTermination()
    return spark.read.parquet(f"{place}/rows")


def stream_filter(spark, sf_dir):
    """An incremental search over a stream of files."""
    s = _stream(spark, sf_dir).where("event_type = 'purchase' AND value > 50").select("event_id", "user_id", "value")
    return _drained(spark, s, "filtered")


def _folded(spark, sf_dir, action, name):
    s = _stream(spark, sf_dir).select(F.col("user_id").alias("id"), action.alias("action"), F.col("event_id").alias("seq"), F.coalesce("value", F.lit(0.0)).alias("value"))
    place = shared_place(spark, name)
    q = edit_log.undoable(s).writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{place}/rows")).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{place}/rows").groupBy("id").agg(F.max_by(F.struct("n_edits", "n_undone", "value"), "batch").alias("s"))
    return last.select("id", "s.n_edits", "s.n_undone", "s.value")


def stream_undo(spark, sf_dir):
    """A stream of edits with undo (error events), folded by state. The last update of each id is its state."""
    return _folded(spark, sf_dir, F.when(F.col("event_type") == "error", "undo").otherwise("edit"), "undo")


def stream_redo(spark, sf_dir):
    """The same with redo (signup events)."""
    return _folded(spark, sf_dir, F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit"), "redo")


def edit_discard(spark, sf_dir):
    """The pending edits of users without errors: those of the others are given up."""
    e = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq"))
    return edits.latest(edits.discard(e, e.where("field = 'error'"))).select("id", "field", "value")


def edit_paste(spark, sf_dir):
    """Two fields of the first customer, pasted to the customers of its nation."""
    c = tables.read(spark, sf_dir, "customer")
    source = c.where("c_custkey = 1")
    targets = c.join(source.select("c_nationkey"), "c_nationkey", "left_semi")
    return edits.pasted(targets, source, "c_custkey", ["c_mktsegment", "c_nationkey"], "paste-1", 500)


def rename_queue(spark, sf_dir):
    """Customers' names shortened, as one operation of the log."""
    c = tables.read(spark, sf_dir, "customer").withColumn("to", F.regexp_replace("c_name", "#0*", "-"))
    return edits.rename_rows(c, "c_custkey", "c_name", "to", "op-1", 1000)


def write_errors(spark, sf_dir):
    """Documents that can't be written, with the stage that says so; all rows stay."""
    d = tables.read(spark, sf_dir, "documents")
    checks = [("commit", "too long", F.length("text") > 5000), ("validate", "no text", F.coalesce(F.trim("text"), F.lit("")) == ""), ("serialise", "control characters", F.col("text").rlike("[\\x00-\\x08]")), ("rename", "no source", F.col("source").isNull())]
    return edits.with_error(d, checks).select("doc_id", "error", "error_stage")


def record_labels(spark, sf_dir):
    """Status, time, identifier, cover addresses and numbered genre of parts."""
    p = tables.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, ["dirty", "error", "unsaved", "clean"])), (k % 4 + 1).cast("int"))
    genre = F.element_at(F.array(F.concat(F.lit("("), k % 100, F.lit(")")), F.concat(F.lit(" "), k % 100), F.lit("(3) Own"), F.col("p_type")), (k % 4 + 1).cast("int"))
    return p.select("p_partkey", _text.status_label(status, k % 3 == 0).alias("status"), _text.show_time(k * 86_400_123).alias("at"), _text.stable_id("part", k.cast("string"), F.col("p_brand")).alias("stable"), F.array_join(_text.cover_urls("https://example.org/release/", k.cast("string")), " ").alias("covers"), _text.id3_genre(genre).alias("genre"))


QUERIES = {f.__name__: f for f in (edit_latest, edit_overlay, edit_diff, edit_undo_n, edit_undone, edit_history_cap, edit_history, edit_upsert, read_back, json_props, stream_filter, stream_undo, stream_redo, edit_discard, edit_paste, rename_queue, write_errors, record_labels)}

ORACLE = {
    "edit_latest": "SELECT user_id AS id, event_type AS field, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1, 2",
    "edit_overlay": "WITH p AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') SELECT c_custkey, coalesce(p.v, c_acctbal) AS c_acctbal, CASE WHEN s.user_id IS NOT NULL THEN 'edited' ELSE c_mktsegment END AS segment, p.user_id IS NOT NULL OR s.user_id IS NOT NULL AS dirty FROM customer LEFT JOIN p ON c_custkey = p.user_id LEFT JOIN s ON c_custkey = s.user_id",
    "edit_diff": "SELECT c_custkey, 'c_acctbal' AS field, '0.5' AS after FROM customer WHERE c_acctbal <> 0.5 AND c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "edit_undo_n": "SELECT user_id AS id, event_type AS field, arg_max(value, event_id) AS value, max(event_id) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r > 3 GROUP BY 1, 2",
    "edit_undone": "WITH e AS (SELECT *, user_id || '/' || date_trunc('day', ts) AS op FROM events), u AS (SELECT op, arg_max(event_type, event_id) AS last FROM e WHERE event_type IN ('error', 'signup') GROUP BY 1) SELECT user_id AS id, event_id AS seq FROM e WHERE event_type = 'click' AND op NOT IN (SELECT op FROM u WHERE last = 'error')",
    "edit_history_cap": "SELECT user_id AS id, event_id AS seq, event_type AS field FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5",
    "edit_history": "SELECT user_id AS id, event_id AS seq FROM events ORDER BY ts DESC, event_id DESC LIMIT 300",
    "edit_upsert": "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events",
    "read_back": "SELECT 3 AS n_nationkey, 'n_name' AS field, n_name AS before, NULL AS after FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 3, 'n_regionkey', n_regionkey::VARCHAR, NULL FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 5, 'n_name', n_name, lower(n_name) FROM nation WHERE n_nationkey = 5 AND n_name <> lower(n_name)",
    "json_props": """SELECT event_id, (props->>'k')::BIGINT AS k, '{"event_id":' || event_id || ',"type":"' || event_type || '"}' AS json FROM events""",
    "stream_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50",
}


def _folding(kind: str) -> str:
    """SQL of the fold of edits by user: a recursion over each user's events in their order, on two lists of values."""
    return f"""
WITH RECURSIVE e AS (SELECT user_id AS id, coalesce(value, 0.0) AS v, {kind} AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (
  SELECT DISTINCT id, 0::BIGINT AS i, []::DOUBLE[] AS stands, []::DOUBLE[] AS back, 0::BIGINT AS undone FROM e
  UNION ALL
  SELECT f.id, e.i, CASE a WHEN 'undo' THEN stands[:-2] WHEN 'redo' THEN CASE WHEN len(back) > 0 THEN list_append(stands, back[-1]) ELSE stands END ELSE list_append(stands, v)[-100:] END,
    CASE a WHEN 'undo' THEN CASE WHEN len(stands) > 0 THEN list_append(back, stands[-1]) ELSE back END WHEN 'redo' THEN back[:-2] ELSE []::DOUBLE[] END,
    undone + CASE WHEN a = 'undo' AND len(stands) > 0 THEN 1 WHEN a = 'redo' AND len(back) > 0 THEN -1 ELSE 0 END
  FROM f JOIN e ON e.id = f.id AND e.i = f.i + 1
)
SELECT id, len(stands)::BIGINT AS n_edits, undone AS n_undone, stands[-1] AS value FROM f WHERE i = (SELECT max(i) FROM e WHERE e.id = f.id)"""


ORACLE["stream_undo"] = _folding("CASE WHEN event_type = 'error' THEN 'undo' ELSE 'edit' END")
ORACLE["stream_redo"] = _folding("CASE WHEN event_type = 'error' THEN 'undo' WHEN event_type = 'signup' THEN 'redo' ELSE 'edit' END")
ORACLE["edit_discard"] = "SELECT user_id AS id, event_type AS field, arg_max(value, event_id) AS value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1, 2"
ORACLE["edit_paste"] = "WITH s AS (SELECT c_mktsegment AS m, c_nationkey AS n FROM customer WHERE c_custkey = 1), t AS (SELECT c_custkey AS id, m, n FROM customer JOIN s ON c_nationkey = n) SELECT id, 'paste-1' AS op, 'c_mktsegment' AS field, m AS value, 500 + id AS seq FROM t UNION ALL SELECT id, 'paste-1', 'c_nationkey', n::VARCHAR, 500 + id FROM t"
ORACLE["rename_queue"] = "SELECT c_custkey AS id, 'op-1' AS op, 'filename' AS field, c_name AS before, regexp_replace(c_name, '#0*', '-') AS value, 1000 + c_custkey AS seq FROM customer WHERE c_name <> regexp_replace(c_name, '#0*', '-')"
ORACLE["write_errors"] = """
SELECT doc_id, CASE s WHEN 'validate' THEN 'no text' WHEN 'serialise' THEN 'control characters' WHEN 'commit' THEN 'too long' WHEN 'rename' THEN 'no source' END AS error, s AS error_stage
FROM (SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'validate' WHEN regexp_matches(text, '[\\x00-\\x08]') THEN 'serialise' WHEN length(text) > 5000 THEN 'commit' WHEN source IS NULL THEN 'rename' END AS s FROM documents)"""
_GENRES = "[" + ", ".join("'" + g + "'" for g in _text.ID3_GENRES) + "]"
ORACLE["record_labels"] = f"""
SELECT p_partkey, CASE k % 4 WHEN 0 THEN 'Unsaved' WHEN 1 THEN 'Error' WHEN 2 THEN 'Unwritten' ELSE CASE WHEN k % 3 = 0 THEN 'Clean' ELSE 'Export' END END AS status, strftime(make_timestamp(k * 86400123000), '%Y-%m-%d %H:%M:%S') AS at,
  'part-' || left(sha256(k || chr(31) || p_brand), 16) AS stable, 'https://example.org/release/' || k || '/front-500 https://example.org/release/' || k || '/front-1200' AS covers,
  CASE k % 4 WHEN 0 THEN coalesce({_GENRES}[k % 100 + 1], '(' || k % 100 || ')') WHEN 1 THEN coalesce({_GENRES}[k % 100 + 1], (k % 100)::VARCHAR) WHEN 2 THEN 'Own' ELSE p_type END AS genre
FROM (SELECT *, p_partkey AS k FROM part)"""
