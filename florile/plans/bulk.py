"""Queries: bytes read late, texts that can't be read, open keys, lists without bound."""

from pyspark.sql import functions as F

from ..functions.binary import big, raw
from ..functions.text import once
from ..operators import keys
from ..session import shared_place
from ..sinks import ordered
from ..sinks.playlists import Track
from ..sources import late, records, releases
from . import tables


def late_pages(spark, sf_dir):
    """The first page of each host, chosen without its html, and the length and digest of that."""
    p = tables.read(spark, sf_dir, "pages")
    slim = p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    out = late.fetched(late.first_of(slim, ["host"], [F.col("page_id")]), p, "page_id", ["html"])
    return out.select("host", "page_id", F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("sha256"))


def late_texts(spark, sf_dir):
    """The three longest documents of each language and source, chosen without their texts, and the texts' digests."""
    d = tables.read(spark, sf_dir, "documents")
    slim = late.first_of(d.select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], [F.col("n_chars").desc(), F.col("doc_id")], 3)
    return late.fetched(slim, d, "doc_id", ["text"]).select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha256"))


def _block(kind, body, last=0):
    return once(body, lambda b: raw(big(F.lit(kind + last), 1), big(F.octet_length(b.cast("binary")), 3), b))


def _picture(kind, mime, data):
    sized = lambda c: once(c, lambda x: raw(big(F.octet_length(x.cast("binary")), 4), x))
    return raw(big(F.lit(kind), 4), sized(F.lit(mime)), sized(F.lit("")), big(F.col("p_size"), 4), big(F.col("p_size") + 1, 4), b"\0" * 8, sized(data))


def artwork_late(spark, sf_dir):
    """Front covers of the largest file of each brand, out of a table of files: sizes and places are chosen first, and pictures' bytes are read for those alone."""
    p = tables.read(spark, sf_dir, "part")
    back = F.when(F.col("p_partkey") % 3 == 0, _block(6, _picture(4, "image/png", F.lit("back")))).otherwise(F.lit(bytearray()))
    front = F.when(F.col("p_partkey") % 5 > 0, _block(6, _picture(3, "image/jpeg", F.concat("p_name", F.lit("/"), "p_type")))).otherwise(F.lit(bytearray()))
    broken = _block(6, raw(big(F.lit(3), 4), big(F.lit(10**6), 4), "image/jpeg"))
    content = raw("fLaC", _block(0, F.lit(bytearray(34))), back, broken, front, _block(1, F.lit(bytearray(8)), 128), b"\xff\xf8 frames")
    place = shared_place(spark, "files")
    p.select("p_partkey", "p_brand", "p_size", content.alias("content")).withColumn("pictures", late.flac_pictures(F.col("content"))).write.parquet(place)
    files = spark.read.parquet(place)
    cover = files.select("p_partkey", "p_brand", "p_size", F.get(F.filter("pictures", lambda x: x["kind"] == 3), 0).alias("cover")).where("cover IS NOT NULL")
    out = late.fetched(late.first_of(cover, ["p_brand"], [F.col("p_size").desc(), F.col("p_partkey")]), files, "p_partkey", ["content"])
    return out.select("p_brand", "p_partkey", "cover.mime", "cover.width", "cover.height", F.decode(late.picture_bytes(F.col("content"), F.col("cover")), "UTF-8").alias("bytes"))


def _props(spark, sf_dir):
    """events with some props broken, each in a way of its own."""
    e, k = tables.read(spark, sf_dir, "events"), F.col("event_id") % 16
    text = F.when(k == 0, F.expr("left(props, length(props) - 1)")).when(k == 1, F.lit(" \n")).when(k == 2, F.lit(None)).when(k == 3, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 4, F.lit('{"k":"many","note":"kept"}')).when(k == 5, F.lit('{"k":null,"note":{"a":1}}')).when(k == 6, F.concat("props", F.lit(" x"))).otherwise(F.col("props"))
    return records.checked(e.select("event_id", "event_type", text.alias("props")), "props", {"k": "bigint", "note": "string", "on": "boolean"})


def props_checked(spark, sf_dir):
    """What can be read of each event's props, and why the rest can't."""
    return _props(spark, sf_dir).select("event_id", "record.k", "record.note", F.array_join("errors", "; ").alias("error"))


def props_parted(spark, sf_dir):
    """Good and bad rows from one pass, summed by their kind of error."""
    good, bad = records.parted(_props(spark, sf_dir), shared_place(spark, "records"))
    good = good.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("record.k").alias("k")).withColumn("error", F.lit(""))
    return good.unionByName(bad.select("event_type", F.explode("errors").alias("error")).groupBy("event_type", "error").agg(F.count("*").alias("n")), allowMissingColumns=True)


def _answers(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    body = F.to_json(F.struct(F.concat(F.lit("r"), "p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") + 1950).cast("string").alias("year")))
    first = p.select(F.when(F.col("p_partkey") % 9 == 0, F.lit("<html>too many requests</html>")).otherwise(body).alias("value"))
    second = p.where("p_partkey % 2 = 0").select(F.when(F.col("p_partkey") % 8 == 0, F.lit(None)).otherwise(body).alias("value"))
    return releases.fan_out({"first": first, "second": second})


def fan_out_hits(spark, sf_dir):
    return releases.hits(_answers(spark, sf_dir)).select("service", "id", "title", "year")


def fan_out_errors(spark, sf_dir):
    """How many answers of each service couldn't be read, and why."""
    return _answers(spark, sf_dir).select("service", F.explode("errors").alias("error")).groupBy("service", "error").agg(F.count("*").alias("n"))


SHARE = 0.02


def frequent_words(spark, sf_dir):
    """Words that make up at least a five-hundredth of all words of the documents, with their exact numbers."""
    words = tables.read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return keys.frequent(words, "word", 0.002)


def open_keys(spark, sf_dir):
    """Events' properties, of which one each is found nowhere else: frequent ones as columns, the rest as JSON."""
    e = tables.read(spark, sf_dir, "events")
    own = F.create_map(F.concat(F.lit("e"), "event_id"), F.lit("1"), "event_type", (F.col("event_id") % 10).cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    rows = e.select("event_id", own.alias("props"))
    return keys.widened(rows, "props", keys.frequent_keys(rows, "props", SHARE))


def long_pls(spark, sf_dir):
    """PLS lists of line items by their number within the order, in three lists: numbers run on over all parts of a list."""
    lines, place = tables.read(spark, sf_dir, "lineitem").withColumn("part", F.col("l_linenumber") % 3), shared_place(spark, "pls")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber")
    t = Track(F.lit("items"), F.concat(name, F.lit(".mp3")), F.array(F.lit("A")), name, F.lit(""), F.lit(None).cast("int"), F.when(F.col("l_orderkey") % 3 > 0, F.col("l_orderkey")), F.lit(None).cast("long"))
    ordered.write_pls(lines, "part", [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], t, f"{place}/lists", f"{place}/sorted")
    return ordered.read_lists(spark, f"{place}/lists")


def _orders(spark, sf_dir):
    return tables.read(spark, sf_dir, "orders")


def long_lists(spark, sf_dir):
    """M3U lists of all orders by priority, a handful of lists of any length, written in parts and read back line by line."""
    o, place = _orders(spark, sf_dir), shared_place(spark, "lists")
    t = Track(F.lit("orders"), F.concat("o_orderkey", F.lit(".mp3")), F.array(F.concat(F.lit("Customer "), "o_custkey")), F.concat(F.lit("Order "), "o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 500), F.col("o_orderkey") * 10)
    ordered.write_m3u(o, "o_orderpriority", [F.col("o_custkey"), F.col("o_orderkey")], t, place)
    return ordered.read_lists(spark, place)


def long_manifests(spark, sf_dir):
    """JSON manifests of orders by status, written in parts with totals in front and read back."""
    o, place = _orders(spark, sf_dir), shared_place(spark, "manifests")
    ordered.write_json(o, "o_orderstatus", [-F.col("o_orderkey")], F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label")), place)
    return ordered.read_lists(spark, place)


QUERIES = {f.__name__: f for f in (late_pages, late_texts, artwork_late, props_checked, props_parted, fan_out_hits, fan_out_errors, frequent_words, open_keys, long_lists, long_manifests, long_pls)}

_PROPS = """
WITH p AS (SELECT event_id, event_type, (props->>'k')::BIGINT AS v, event_id % 16 AS w FROM events),
r AS (SELECT event_id, event_type, CASE WHEN w > 6 THEN v END AS k, CASE w WHEN 4 THEN 'kept' WHEN 5 THEN '{"a":1}' END AS note,
  CASE w WHEN 0 THEN 'broken' WHEN 1 THEN 'empty' WHEN 2 THEN 'absent' WHEN 3 THEN 'no object' WHEN 4 THEN 'k: no bigint' WHEN 6 THEN 'broken' ELSE '' END AS error FROM p) """
ORACLE = {
    "late_pages": "WITH h AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages), f AS (SELECT host, min(page_id) AS page_id FROM h GROUP BY 1) SELECT f.host, f.page_id, strlen(html)::INTEGER AS bytes, sha256(html) AS sha256 FROM f JOIN pages USING (page_id)",
    "late_texts": "SELECT doc_id, lang, source, sha256(text) AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r <= 3",
    "artwork_late": "SELECT p_brand, p_partkey, 'image/jpeg' AS mime, p_size::BIGINT AS width, p_size::BIGINT + 1 AS height, p_name || '/' || p_type AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_partkey % 5 > 0) WHERE r = 1",
    "props_checked": _PROPS + "SELECT event_id, k, note, error FROM r",
    "props_parted": _PROPS + "SELECT event_type, count(*) AS n, sum(k)::BIGINT AS k, error FROM r GROUP BY event_type, error",
    "fan_out_hits": "SELECT 'first' AS service, 'r' || p_partkey AS id, p_name AS title, p_size + 1950 AS year FROM part WHERE p_partkey % 9 > 0 UNION ALL SELECT 'second', 'r' || p_partkey, p_name, p_size + 1950 FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 8 > 0",
    "fan_out_errors": "SELECT 'first' AS service, 'broken' AS error, count(*) AS n FROM part WHERE p_partkey % 9 = 0 HAVING count(*) > 0 UNION ALL SELECT 'second', 'absent', count(*) FROM part WHERE p_partkey % 8 = 0 HAVING count(*) > 0",
    "frequent_words": "WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents), s AS (SELECT word FROM w WHERE word <> '') SELECT word, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 0.002 * (SELECT count(*) FROM s)",
    "open_keys": "SELECT event_id, props->>'k' AS custom_k, "
    + ", ".join(f"CASE WHEN event_type = '{t}' THEN (event_id % 10)::VARCHAR END AS custom_{t}" for t in ("click", "error", "purchase", "signup", "view"))
    + """, '{"e' || event_id || '":"1"}' AS rest FROM events""",
    "long_lists": """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS r FROM orders),
l AS (
  SELECT o_orderpriority AS list, 0 AS r, ['#EXTM3U', '#PLAYLIST:Customer ' || o_custkey || ' — ' || o_orderpriority] AS x FROM o WHERE r = 1
  UNION ALL
  SELECT o_orderpriority, r, list_filter(['#EXTINF:' || CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 500 ELSE -1 END || ',Customer ' || o_custkey || ' - Order ' || o_orderkey, '#EXTALB:' || o_orderpriority, '#EXTTRACK:' || o_custkey,
    CASE WHEN o_orderkey % 4 > 0 THEN '#EXTBYT:' || o_orderkey * 10 END, '/orders/' || o_orderkey || '.mp3'], lambda y: y IS NOT NULL) FROM o),
u AS (SELECT list, r, unnest(x) AS value, generate_subscripts(x, 1) AS i FROM l)
SELECT list, row_number() OVER (PARTITION BY list ORDER BY r, i) AS number, value FROM u""",
    "long_manifests": """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderstatus AS list, r + 1 AS number, '{"id":' || o_orderkey || ',"label":"' || o_orderpriority || '"}' || CASE WHEN r < n THEN ',' ELSE '' END AS value FROM o
UNION ALL SELECT DISTINCT o_orderstatus, 1, '{"files":' || n || ',"tracks":[' FROM o UNION ALL SELECT DISTINCT o_orderstatus, n + 2, ']}' FROM o""",
}
ORACLE["long_pls"] = """
WITH l AS (SELECT (l_linenumber % 3)::VARCHAR AS list, l_orderkey AS o, l_orderkey || '-' || l_linenumber AS name, row_number() OVER (PARTITION BY l_linenumber % 3 ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem),
u AS (
  SELECT list, r, unnest(x) AS value, generate_subscripts(x, 1) AS i
  FROM (SELECT list, r, CASE WHEN o % 3 > 0 THEN ['File' || r || '=/items/' || name || '.mp3', 'Title' || r || '=A - ' || name, 'Length' || r || '=' || o] ELSE ['File' || r || '=/items/' || name || '.mp3', 'Title' || r || '=A - ' || name] END AS x FROM l)
  UNION ALL SELECT DISTINCT list, 0, '[playlist]', 1 FROM l UNION ALL SELECT list, max(r) + 1, 'NumberOfEntries=' || count(*), 1 FROM l GROUP BY list UNION ALL SELECT list, max(r) + 1, 'Version=2', 2 FROM l GROUP BY list)
SELECT list, row_number() OVER (PARTITION BY list ORDER BY r, i) AS number, value FROM u"""
