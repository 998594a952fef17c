"""Queries: action steps, replacement in scopes, tag mapping, checks before writing, releases applied."""

from pyspark.sql import functions as F

from ..operators import actions, duplicates, edits, search, stats, templates
from ..session import shared_place
from ..sinks import exports
from ..sources import files, releases
from ..streaming import edit_log
from . import tables


def _records(spark, sf_dir):
    """Parts as records: the brand is the artist, the words of the name genres, the size a year or a track."""
    p = tables.read(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.concat("p_brand", F.lit(" feat. "), "p_type").alias("artist"), F.array(F.concat("p_brand", F.lit(" feat. "), "p_type"), F.col("p_type")).alias("artists"), F.lit(None).cast("string").alias("album_artist"), F.lit(None).cast("array<string>").alias("album_artists"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(1950) + F.col("p_size"), F.lit("-07-01"))).alias("date"), F.when(F.col("p_size") % 3 == 0, F.lit(1950) + F.col("p_size")).alias("year"), F.concat_ws(" ", "p_size", "p_name").alias("name"), F.lit(None).cast("int").alias("track"), F.lit(False).alias("compilation"), F.col("p_name").alias("comment"),
    )


def action_plan(spark, sf_dir):
    steps = actions.STEPS
    out = actions.apply(_records(spark, sf_dir), [steps["albumartist-from-artist"](), steps["strip-featured"](), steps["year-from-date"](), steps["date-from-year"]("full"), steps["track-number-from-filename"](), steps["compilation-flag"](), steps["clear-comment"]()])
    return out.select("p_partkey", "artist", F.array_join("artists", "|").alias("artists"), "album_artist", "date", "year", "track", "compilation", "comment", F.array_join("changes.field", ",").alias("changed"))


def action_split(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("artist", F.translate("comment", " ", ";"))
    out = actions.apply(r, [actions.split_artists(), actions.replace_text(["comment", "artists"], "e", "_")])
    return out.select("p_partkey", "artist", F.array_join("artists", "|").alias("artists"), "comment")


def replace_scopes(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("custom", F.create_map(F.lit("mood"), F.col("comment")))
    out = actions.replace_in_scopes(r, ["name", "artists", "custom"], "STANDARD", "std")
    return out.select("p_partkey", "name", F.array_join("artists", "|").alias("artists"), F.try_element_at("custom", F.lit("mood")).alias("mood"), F.col("hits").cast("long").alias("hits"), F.size("changes").cast("long").alias("n_changes"))


def tag_mapping(spark, sf_dir):
    """Orders' fields as native tags, mapped to two fields."""
    o = tables.read(spark, sf_dir, "orders")
    tag = lambda k, *v: F.struct(F.lit(k).alias("key"), F.array(*v).alias("values"))
    raw = o.select("o_orderkey", F.array(tag("TPE1", F.col("o_orderstatus"), F.col("o_orderpriority")), tag("TXXX", F.col("o_custkey").cast("string")), tag("TIT2", F.lit("t"))).alias("tags"))
    mapping = spark.createDataFrame([("TPE1", "artist", 2), ("TXXX", "artist", 1), ("TIT2", "title", 1), ("TALB", "album", 1)], "key string, field string, rank int")
    return actions.mapping_preview(raw, "o_orderkey", mapping)


def write_checks(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    known = F.array(*[F.lit(f[0]) for f in files.FORMATS])
    r = p.select("p_partkey", F.element_at(known, (F.col("p_partkey") % len(files.FORMATS) + 1).cast("int")).alias("format"), (F.col("p_size") % 2).alias("images"), F.when(F.col("p_size") > 25, "la la").alias("lyrics"), F.split("p_name", " ").alias("genres"), F.concat(F.col("p_name"), F.when(F.col("p_size") == 7, "\x01").otherwise("")).alias("title"))
    return actions.write_issues(r, "p_partkey", "format", files.formats(spark), "images", "lyrics", ["genres"], ["title"])


def release_applied(spark, sf_dir):
    """Line items as records of the release that is their order."""
    lines = tables.read(spark, sf_dir, "lineitem")
    o = tables.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    tracks = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(F.col("l_linenumber").cast("int").alias("position"), F.concat(F.lit("Track "), "l_linenumber").alias("title")))).alias("tracks"))
    releases = o.join(tracks, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.array(F.lit("A"), F.col("o_orderstatus")).alias("artists"), F.year("o_orderdate").alias("year"), F.filter("tracks", lambda t: t["position"] != 2).alias("tracks"))
    records = lines.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").cast("int").alias("track"), F.lit("own").alias("title"), F.lit("own album").alias("album"), F.lit(None).cast("string").alias("album_artist"), F.lit(None).cast("int").alias("year"), "l_partkey")
    return actions.apply_release(records, releases).select("l_orderkey", "l_linenumber", "l_partkey", "title", "album", "album_artist", "year")


def action_artist(spark, sf_dir):
    """Artists from album artists, then texts cleaned: white space, characters of two code points, ones without width."""
    p = tables.read(spark, sf_dir, "part")
    r = p.select("p_partkey", F.col("p_brand").alias("artist"), F.array("p_brand").alias("artists"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("album_artist"), F.when(F.col("p_size") % 2 == 0, F.array("p_type", "p_brand")).alias("album_artists"), F.concat(F.lit("  e\u0301\u200b "), "p_name", F.lit("   x ")).alias("comment"))
    out = actions.apply(r, [actions.STEPS["artist-from-albumartist"](), actions.STEPS["cleanup-text"](["comment"])])
    return out.select("p_partkey", "artist", F.array_join("artists", "|").alias("artists"), "comment", F.array_join(F.array_sort("changes.field"), ",").alias("changed"))


def capability_totals(spark, sf_dir):
    """How many parts are in formats that can be read, be written, and lose nothing."""
    p = tables.read(spark, sf_dir, "part")
    known = F.array(*[F.lit(f[0]) for f in files.FORMATS])
    r = p.select("p_size", F.element_at(known, (F.col("p_partkey") % len(files.FORMATS) + 1).cast("int")).alias("format")).join(F.broadcast(files.formats(spark)), "format")  # 28 rows
    return stats.totals(r, F.col("p_size"), {k: F.col(k) for k in ("readable", "writable", "lossless")})


def clause_counts(spark, sf_dir):
    """What each part of a search lets through."""
    return search.clause_counts(tables.documents(spark, sf_dir), 'format:=en size:>=1000 -folder:web the -"zzz"')


def rename_presets(spark, sf_dir):
    """Parts' names by every ready template."""
    c = tables.parts(spark, sf_dir)
    made = F.array(*[F.struct(F.lit(label).alias("label"), path.alias("path"), F.array_join(missing, ",").alias("missing")) for label, t in templates.RENAME_TEMPLATES.items() for path, missing in [templates.generate(c, t)]])
    return c.rows.select("p_partkey", F.explode(made).alias("x")).select("p_partkey", "x.*")


def stream_latest(spark, sf_dir):
    """The running last value of each user and type, of events that come as a stream; the last update of each counts."""
    events = tables.read(spark, sf_dir, "events")
    s = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    log = s.select(F.col("user_id").alias("id"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq"))
    place = shared_place(spark, "latest")
    q = edit_log.latest_values(log).writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{place}/rows/n={i}")).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return edits.latest(spark.read.parquet(f"{place}/rows")).select("id", "field", "value", "seq")


def dup_loose(spark, sf_dir):
    """Orders of one customer and status whose totals are near, as if artist, album and length."""
    o = tables.read(spark, sf_dir, "orders")
    signal = duplicates.loose_signature(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice") / 1000, 50.0)
    return duplicates.members(o, "o_orderkey", {"loose": signal}, [F.col("o_totalprice")], F.lit(1)).select("key", F.col("id").alias("o_orderkey"), "is_keeper", "n")


def write_preview(spark, sf_dir):
    """Bytes of customers' lines before and after a change of some segments, with some new and some gone."""
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    after = c.where(k % 9 != 4).withColumn("c_mktsegment", F.when(k % 3 == 0, F.lit('a, "b"')).otherwise(F.col("c_mktsegment")))
    return exports.write_preview(c.where(k % 9 != 5), after, "c_custkey")


def artwork_placeholders(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    one = lambda kind, width: F.struct(F.concat(F.lit(f"{kind}-"), "p_partkey").alias("id"), F.concat(F.lit("https://example.org/"), "p_partkey").alias("url"), F.lit(kind).alias("type"), width.alias("width"), F.lit(None).cast("int").alias("height"))
    made = releases.placeholders(F.array(one("Front", F.col("p_size")), one("Medium", F.when(F.col("p_size") > 25, F.col("p_size")))))
    return p.select("p_partkey", F.explode(made).alias("a")).select("p_partkey", "a.*")


QUERIES = {f.__name__: f for f in (action_plan, action_split, replace_scopes, tag_mapping, write_checks, release_applied, action_artist, capability_totals, clause_counts, rename_presets, stream_latest, dup_loose, write_preview, artwork_placeholders)}

ORACLE = {
    "action_plan": """SELECT p_partkey, p_brand AS artist, p_brand || '|' || p_type AS artists, p_brand || ' feat. ' || p_type AS album_artist,
CASE WHEN p_size % 2 = 0 THEN (1950 + p_size) || '-07-01' WHEN p_size % 3 = 0 THEN (1950 + p_size) || '-01-01' END AS date, CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN 1950 + p_size END AS year, p_size AS track, true AS compilation, '' AS comment,
concat_ws(',', 'album_artists', 'album_artist', 'artists', 'artist', CASE WHEN p_size % 2 = 0 AND p_size % 3 > 0 THEN 'year' END, CASE WHEN p_size % 2 = 1 AND p_size % 3 = 0 THEN 'date' END, 'track', 'compilation', CASE WHEN p_name <> '' THEN 'comment' END) AS changed FROM part""",
    "replace_scopes": "SELECT p_partkey, regexp_replace(p_size || ' ' || p_name, '(?i)standard', 'std', 'g') AS name, regexp_replace(p_brand || ' feat. ' || p_type || '|' || p_type, '(?i)standard', 'std', 'g') AS artists, regexp_replace(p_name, '(?i)standard', 'std', 'g') AS mood, len(regexp_extract_all(p_name || p_name || p_type || p_type || p_brand, '(?i)standard'))::BIGINT AS hits, len(regexp_extract_all(p_name || p_name || p_type || p_type || p_brand, '(?i)standard'))::BIGINT AS n_changes FROM part",
    "tag_mapping": "SELECT o_orderkey, 'artist' AS field, o_custkey || ' / ' || o_orderstatus || ' & ' || o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'title', 't' FROM orders",
    "write_checks": f"""WITH r AS (SELECT * FROM part JOIN {tables.FORMATS_SQL} ON p_partkey % 28 = i)
SELECT p_partkey, 'format' AS field, 'error' AS severity FROM r WHERE NOT writable UNION ALL SELECT p_partkey, 'artwork', 'error' FROM r WHERE p_size % 2 = 1 AND NOT artwork
UNION ALL SELECT p_partkey, 'lyrics', 'warning' FROM r WHERE p_size > 25 AND NOT lyrics UNION ALL SELECT p_partkey, 'genres', 'warning' FROM r WHERE contains(p_name, ' ') AND NOT multi UNION ALL SELECT p_partkey, 'control-characters', 'warning' FROM r WHERE p_size = 7""",
    "release_applied": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey IS NOT NULL AND l_linenumber <> 2 THEN 'Track ' || l_linenumber ELSE 'own' END AS title, coalesce(o_orderpriority, 'own album') AS album, CASE WHEN o_orderkey IS NOT NULL THEN 'A & F' END AS album_artist, year(o_orderdate)::INT AS year FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'",
}
ORACLE["action_split"] = """SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE p_name END AS artist,
regexp_replace(p_brand || ' feat. ' || p_type || '|' || p_type, '(?i)e', '_', 'g') AS artists, regexp_replace(p_name, '(?i)e', '_', 'g') AS comment FROM part"""

_NFC = "chr(233)"
ORACLE["action_artist"] = f"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS artist, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS artists, {_NFC} || ' ' || p_name || ' x' AS comment,
CASE WHEN p_size % 2 = 0 THEN 'artist,artists,comment' ELSE 'comment' END AS changed FROM part"""
ORACLE["capability_totals"] = f"SELECT count(*) AS n_rows, sum(p_size)::BIGINT AS bytes, count_if(readable)::BIGINT AS readable, count_if(writable)::BIGINT AS writable, count_if(lossless)::BIGINT AS lossless FROM part JOIN {tables.FORMATS_SQL} ON p_partkey % 28 = i"
ORACLE["clause_counts"] = """
WITH d AS (SELECT coalesce(lower(lang) = 'en', false) AS a, coalesce(n_chars >= 1000, false) AS b, coalesce(NOT contains(lower(source), 'web'), true) AS c, lower(concat_ws(' ', text, lang, source)) AS h FROM documents),
e AS (SELECT a, b, c, contains(h, 'the') AS w, NOT contains(h, 'zzz') AS z FROM d)
SELECT 0 AS place, 'format = en' AS clause, count_if(a)::BIGINT AS n FROM e UNION ALL SELECT 1, 'size >= 1000', count_if(b) FROM e UNION ALL SELECT 2, 'not folder != web', count_if(c) FROM e
UNION ALL SELECT 3, 'with the', count_if(w) FROM e UNION ALL SELECT 4, 'without zzz', count_if(z) FROM e UNION ALL SELECT 5, 'all', count_if(a AND b AND c AND w AND z) FROM e"""
ORACLE["rename_presets"] = r"""
WITH p AS (SELECT p_partkey, lpad(p_size::VARCHAR, 2, '0') AS track, trim(regexp_replace(p_brand || ' & ' || p_type || ' - ' || p_name, '[\s]+', ' ', 'g')) AS pair, p_name AS t, p_brand AS album FROM part)
SELECT p_partkey, 'Artist - Title' AS label, pair AS path, '' AS missing FROM p UNION ALL SELECT p_partkey, 'Track - Title', track || ' - ' || t, '' FROM p
UNION ALL SELECT p_partkey, 'Disc-Track - Title', '-' || track || ' - ' || t, 'disc' FROM p UNION ALL SELECT p_partkey, 'Track. Title', track || '. ' || t, '' FROM p
UNION ALL SELECT p_partkey, 'Album / Track - Title', album || '/' || track || ' - ' || t, '' FROM p
UNION ALL SELECT p_partkey, 'Album artist / Year - Album / Track - Title', 'Unknown/- ' || album || '/-' || track || ' - ' || t, 'albumartist,year,disc' FROM p"""
ORACLE["stream_latest"] = "SELECT user_id AS id, event_type AS field, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1, 2"
ORACLE["dup_loose"] = """
WITH o AS (SELECT *, o_custkey || '|' || lower(o_orderstatus) || '|' || floor(o_totalprice / 1000 / 50 + 0.5)::BIGINT AS key FROM orders)
SELECT key, o_orderkey, row_number() OVER (PARTITION BY key ORDER BY o_totalprice DESC, o_orderkey) = 1 AS is_keeper, count(*) OVER (PARTITION BY key) AS n FROM o QUALIFY count(*) OVER (PARTITION BY key) > 1"""
ORACLE["write_preview"] = """
WITH c AS (SELECT c_custkey, c_custkey % 9 AS w, c_custkey % 3 = 0 AS moved, strlen(c_custkey || ',' || c_name || ',') AS base, strlen(c_mktsegment) AS seg FROM customer)
SELECT c_custkey, CASE WHEN w <> 5 THEN base + seg END::INTEGER AS bytes_before, CASE WHEN w <> 4 THEN base + CASE WHEN moved THEN 10 ELSE seg END END::INTEGER AS bytes_after FROM c WHERE w IN (4, 5) OR moved"""
ORACLE["artwork_placeholders"] = """
SELECT p_partkey, k || '-' || p_partkey AS id, 'https://example.org/' || p_partkey AS url, 'front' AS role, k AS description, 'image/jpeg' AS mime, CASE WHEN k = 'Front' OR p_size > 25 THEN p_size ELSE 0 END AS width, 0 AS height, 0 AS bytes
FROM part, (VALUES ('Front'), ('Medium')) AS v(k)"""
