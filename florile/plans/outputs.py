"""Queries: CSV lines, templates, manifests, playlists, and files as rows."""

from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..operators import stats
from ..sinks import exports, playlists
from ..sources import files, releases
from . import tables


def _turns(spark, sf_dir):
    """Conversations as playlists: conv_id is the list, turn its order."""
    return tables.read(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")


def csv_line(spark, sf_dir):
    c = _turns(spark, sf_dir)
    return c.select("conv_id", "turn", F.sha2(exports.csv_line([F.col("conv_id"), F.col("role"), F.col("text")]), 256).alias("line"))


def export_flat(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"), (F.col("p_size") > 20).alias("large"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("custom"))
    return exports.flat(p, "custom", ["brand", "other"])


def export_totals(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    return exports.totals(p, "p_size", "p_size", "p_brand", "p_type")


def xml_text(spark, sf_dir):
    c = _turns(spark, sf_dir)
    return c.select("conv_id", "turn", F.sha2(xml_escape(F.col("text")), 256).alias("text"))


def template_rows(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    t = "<b>{{name}}</b> {{{brand}}}{{^missing}} none of {{size}}{{/missing}}{{unknown}}"
    return p.select("p_partkey", exports.rendered(t, {"name": F.concat("p_name", F.lit(" <&>")), "brand": F.col("p_brand"), "size": F.col("p_size"), "missing": F.lit(None).cast("string")}, "html").alias("text"))


def template_document(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    out = exports.render_document(o, ["o_orderpriority", "o_orderstatus"], [F.col("o_orderkey")], "# list\n{{#tracks}}- {{key}}: {{price}}\n{{/tracks}}end", {"key": F.col("o_orderkey"), "price": F.floor("o_totalprice")})
    return out.select("o_orderpriority", "o_orderstatus", F.sha2("content", 256).alias("content"))


def json_manifest(spark, sf_dir):
    c = _turns(spark, sf_dir).select("conv_id", "turn", "role")
    return exports.manifest(c, ["conv_id"], [F.col("turn"), F.col("role")], F.struct("turn", "role"))


def m3u_block(spark, sf_dir):
    c = _turns(spark, sf_dir)
    path = playlists.track_path(F.col("role"), F.concat(F.col("turn").cast("string"), F.lit(".mp3")))
    entry = playlists.m3u_entry(playlists.shown_title(F.col("role"), F.col("text"), F.lit("?")), F.length("text") / 10.0, path)
    return playlists.m3u(c, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], entry).select("conv_id", F.sha2("content", 256).alias("content"))


def pls_index(spark, sf_dir):
    c = _turns(spark, sf_dir)
    out = playlists.pls(c, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], F.col("role"), F.lit(None).cast("double"), F.concat(F.lit("/"), F.col("role")))
    return out.select("conv_id", F.sha2("content", 256).alias("content"))


def xspf_list(spark, sf_dir):
    c = _turns(spark, sf_dir)
    out = playlists.xspf(c, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], F.col("text"), F.lit(2.5), F.concat(F.lit("/"), F.col("role")))
    return out.select("conv_id", F.sha2("content", 256).alias("content"))


def _orders(spark, sf_dir):
    """Orders of each customer as tracks: some without artists, title, album, number or length."""
    o = tables.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    some = lambda n, c: F.when(k % n > 0, c)
    t = playlists.Track(
        F.concat(F.lit("/music/"), "o_orderpriority"), F.concat(k.cast("string"), F.lit(".mp3")), some(3, F.array(F.col("o_orderstatus"), F.lit("A & B"))), some(4, F.concat(F.lit(" t\n<"), k.cast("string"), F.lit("> "))),
        some(5, F.col("o_orderpriority")), some(2, F.col("o_custkey")), some(7, F.floor(F.col("o_totalprice")) / 4), F.floor(F.col("o_totalprice")).cast("long"),
    )
    return o, t


def _hashed(df, key="o_custkey"):
    return df.select(key, F.sha2("content", 256).alias("content"))


def m3u_lists(spark, sf_dir):
    o, t = _orders(spark, sf_dir)
    return _hashed(playlists.m3u_list(o, ["o_custkey"], [F.col("o_orderkey")], t))


def m3u_plain(spark, sf_dir):
    """Paths alone, relative to a base folder."""
    o, t = _orders(spark, sf_dir)
    return _hashed(playlists.m3u_list(o, ["o_custkey"], [F.col("o_orderkey")], t, absolute=False, base="../lists/", extended=False))


def pls_lists(spark, sf_dir):
    o, t = _orders(spark, sf_dir)
    return _hashed(playlists.pls_list(o, ["o_custkey"], [F.col("o_orderkey")], t, absolute=False))


def xspf_lists(spark, sf_dir):
    o, t = _orders(spark, sf_dir)
    return _hashed(playlists.xspf_document(o, ["o_custkey"], [F.col("o_orderkey")], t))


def _fields(t):
    name = {"filename": t.name, "title": t.title, "artist": F.array_join(t.artists, "; "), "album": t.album, "track": t.number, "year": F.year("o_orderdate"), "format": F.lit("mp3")}
    return name | {"duration": F.floor(t.seconds + 0.5), "size": t.size, "folder": t.folder}


def table_export(spark, sf_dir):
    """Each order's line of the table of 27 columns, and of the table of 16."""
    o, t = _orders(spark, sf_dir)
    return o.select("o_orderkey", exports.table_line(_fields(t)).alias("line"), exports.table_line(_fields(t), technical=False, delimiter=";").alias("basic"))


def export_documents(spark, sf_dir):
    """Every built-in template, tables and the manifest among them, over the orders of each customer."""
    o, t = _orders(spark, sf_dir)
    out = None
    for name in ("csv-basic", "json-manifest", *exports.TEMPLATES):
        own = _hashed(exports.export(o, ["o_custkey"], [F.col("o_orderkey")], _fields(t), name, "2020-01-01 00:00:00", technical=False)).withColumn("template", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def manifest_totals(spark, sf_dir):
    o, t = _orders(spark, sf_dir)
    return exports.library_manifest(o, ["o_custkey"], [F.col("o_orderkey")], F.struct(F.col("o_orderkey").alias("key")), t.album, t.artists, t.size, "2020-01-01")


def row_index(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    return stats.numbered(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", F.col("index").cast("long").alias("index"))


def sniff_bytes(spark, sf_dir):
    """Containers of bytes made from the table: leading marks before each text, and names whose extension decides where no mark does."""
    d = tables.read(spark, sf_dir, "documents")
    marks = F.array(*[F.lit(bytearray(b)) for b in (b"fLaC\x00\x00\x00\x22", b"ID3\x04\x00\x00", b"RIFF\x24\x00\x00\x00WAVEfmt ", b"OggS\x00\x02", b"\x00\x00\x00\x20ftypM4A ", b"", b"\xff\xf1\x50")])
    content = F.concat(F.element_at(marks, (F.col("doc_id") % 7 + 1).cast("int")), F.encode("text", "UTF-8"))
    name = F.concat(F.col("source"), F.when(F.col("doc_id") % 2 == 0, ".WMA").otherwise(".txt"))
    return d.select("doc_id", files.sniff(content, name).alias("format"))


def trailer_tags(spark, sf_dir):
    """ID3v1 trailers made from part names behind their text, read back."""
    p = tables.read(spark, sf_dir, "part")
    cell = lambda c, n: F.rpad(F.substring(c, 1, n), n, "\x00")
    tail = F.concat(F.lit("TAG"), cell(F.col("p_name"), 30), cell(F.col("p_brand"), 30), cell(F.col("p_type"), 30), F.lit("1999"), cell(F.lit("note"), 28), F.lit("\x00"), F.chr(F.col("p_size")), F.lit("\x07"))
    content = F.encode(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 > 0, tail).otherwise(F.lit("x"))), "ISO-8859-1")
    tags = files.id3v1(content)
    return p.select("p_partkey", *[v.alias(k) for k, v in tags.items()])


def media_numbers(spark, sf_dir):
    """Stream properties and image sizes of headers made from part sizes."""
    p = tables.read(spark, sf_dir, "part")
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    packed = F.shiftleft(F.lit(44100).cast("long"), 44) + F.shiftleft(F.lit(1).cast("long"), 41) + F.shiftleft(F.lit(15).cast("long"), 36) + F.col("p_partkey") * 44100
    flac = F.unhex(F.concat(F.lit("664C6143000000221000100000000000000000"[:36]), hexed(packed, 16)))
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(F.col("p_size"), 8), hexed(F.col("p_partkey"), 8)))
    f, size = files.flac_properties(flac), files.image_size(png)
    w, h = files.scaled(size["width"], size["height"], 100)
    return p.select("p_partkey", f["sample_rate"].alias("rate"), f["channels"].cast("long").alias("channels"), f["bits"].cast("long").alias("bits"), f["seconds"].alias("seconds"), size["width"].alias("width"), size["height"].alias("height"), w.alias("thumb_w"), h.alias("thumb_h"), files.storable(size["mime"], F.lit("mp4")).alias("storable"))


def image_sizes(spark, sf_dir):
    """Sizes of GIF, BMP, WebP (of three kinds) and JPEG headers made from part sizes, whether they can be stored in MP4 and elsewhere; and none."""
    p = tables.read(spark, sf_dir, "part")
    w, h = F.col("p_size"), (F.col("p_partkey") % 5000 + 1).cast("int")
    big = lambda c, n: F.lpad(F.hex(c), n, "0")
    little = lambda c, n: F.concat(*[F.substring(big(c, n), 2 * i + 1, 2) for i in range(n // 2 - 1, -1, -1)])
    riff = lambda kind: F.concat(F.lit("52494646000000005745425056503820"[:24]), F.hex(F.lit(kind)), F.lit("00000000"))
    packed = w.cast("long") - 1 + F.shiftleft(h.cast("long") - 1, 14)
    made = [
        F.concat(F.lit("474946383961"), little(w, 4), little(h, 4)), F.concat(F.lit("424D" + "00" * 16), little(w, 8), little(h, 8)), F.concat(riff("VP8X"), F.lit("00000000"), little(w - 1, 6), little(h - 1, 6)),
        F.concat(riff("VP8L"), F.lit("2F"), little(packed, 8)), F.concat(riff("VP8 "), F.lit("0000009D012A"), little(w, 4), little(h, 4)), F.concat(F.lit("FFD8FFE00010" + "00" * 14 + "FFDB0004AAAAFFC2001108"), big(h, 4), big(w, 4), F.lit("03")),
        F.concat(F.lit("FFD8FFE00010" + "00" * 14 + "FFDA0002"), big(h, 4)), F.lit("00"),
    ]
    size = files.image_size(F.unhex(F.element_at(F.array(*made), (F.col("p_partkey") % 8 + 1).cast("int"))))
    out = p.select("p_partkey", size.alias("s")).select("p_partkey", "s.mime", "s.width", "s.height")
    return out.withColumns({"in_mp4": files.storable(F.col("mime"), F.lit("m4a")), "elsewhere": files.storable(F.col("mime"), F.lit("flac"))})


def wav_numbers(spark, sf_dir):
    """Stream properties of WAV headers made from part sizes."""
    p = tables.read(spark, sf_dir, "part")
    little = lambda c, n: F.concat(*[F.substring(F.lpad(F.hex(c), n, "0"), 2 * i + 1, 2) for i in range(n // 2 - 1, -1, -1)])
    head = F.concat(F.lit("52494646" + "00" * 4 + "57415645666D742010000000" + "0100"), little(F.col("p_size") % 8 + 1, 4), little(F.col("p_partkey") * 10, 8), F.lit("00" * 6), little(F.col("p_size") % 4 * 8 + 8, 4))
    own = files.wav_properties(F.unhex(F.when(F.col("p_partkey") % 5 > 0, head).otherwise("00")))
    return p.select("p_partkey", *[v.alias(k) for k, v in own.items()])


def release_union(spark, sf_dir):
    """Releases of two services, one of which lacks columns, with credits joined by their phrases."""
    c, s = tables.read(spark, sf_dir, "customer"), tables.read(spark, sf_dir, "supplier")
    name = lambda n, j: F.struct(n.alias("name"), j.alias("joinphrase"))
    one = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), releases.credit(F.array(name(F.col("c_name"), F.lit(" feat. ")), name(F.col("c_mktsegment"), F.lit(None).cast("string")))).alias("artist"), F.col("c_nationkey").alias("year"))
    two = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("artist"))
    return releases.union([one, two])


def format_matrix(spark, sf_dir):
    """Every format with the count of pages' names that have its extension, given by page number."""
    known = files.formats(spark)
    p = tables.read(spark, sf_dir, "pages").select(F.element_at(F.array(*[F.lit(f[0]) for f in files.FORMATS[:7]]), (F.col("page_id") % 7 + 1).cast("int")).alias("ext"))
    return stats.with_dimension(p, "ext", known, "format").select("format", "lossless", "writable", "n_rows")


def release_json(spark, sf_dir):
    """Orders as stored release documents in two shapes, read through the release schema."""
    lines = tables.read(spark, sf_dir, "lineitem")
    track = F.struct(F.col("l_linenumber").cast("int").alias("position"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("title"), (F.col("l_quantity") * 1000).alias("length"))
    discs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(track)).alias("tracks"))
    first = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), F.lit("1998-03").alias("date"), F.array(F.struct(F.lit("A").alias("name"), F.lit(" & ").alias("joinphrase")), F.struct(F.lit("B").alias("name"), F.lit("").alias("joinphrase"))).alias("artist-credit"), F.array(F.struct(F.lit(1).alias("position"), F.col("tracks").alias("tracks"))).alias("media")))
    second = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), F.lit("2001").alias("year"), F.array(F.struct(F.lit("C (2)").alias("name"))).alias("artists"), F.transform("tracks", lambda t: F.struct(t["title"].alias("title"), F.concat(F.lit("1:"), F.lpad(t["position"].cast("string"), 2, "0")).alias("duration"))).alias("tracklist")))
    raw = discs.select(F.from_json(F.when(F.col("l_orderkey") % 2 == 0, first).otherwise(second), releases.SCHEMA).alias("r")).select("r.*")
    out = releases.releases(raw)
    total = F.aggregate(F.transform("tracks", lambda t: t["seconds"]), F.lit(0.0), lambda a, x: a + x)
    return out.select("id", F.array_join("artists", " & ").alias("artists"), "year", F.col("track_count").cast("long").alias("track_count"), F.round(total, 3).alias("seconds"))


def search_texts(spark, sf_dir):
    """Queries for a release service: a barcode alone where there is one, else artist and album."""
    p = tables.read(spark, sf_dir, "part")
    code = F.when(F.col("p_size") > 25, F.col("p_partkey").cast("string")).otherwise("")
    return p.select("p_partkey", releases.search_text({"artist": F.col("p_brand"), "release": F.concat("p_name", F.lit(" (x)")), "barcode": code}).alias("query"))


QUERIES = {f.__name__: f for f in (csv_line, export_flat, export_totals, xml_text, template_rows, template_document, json_manifest, m3u_block, m3u_lists, m3u_plain, pls_index, pls_lists, xspf_list, xspf_lists, table_export, export_documents, manifest_totals, row_index, sniff_bytes, trailer_tags, media_numbers, image_sizes, wav_numbers, release_union, format_matrix, release_json, search_texts)}

_CELL = "CASE WHEN regexp_matches({0}, '[,\"\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_XML = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_NAME = "p_name || ' <&>'"
_C = "(SELECT * FROM conversations WHERE conv_id IS NOT NULL)"
ORACLE = {
    "csv_line": f"SELECT conv_id, turn, sha256(conv_id || ',' || {_CELL.format('role')} || ',' || {_CELL.format('text')}) AS line FROM {_C}",
    "export_flat": "SELECT p_partkey::VARCHAR AS p_partkey, replace(p_name, ' ', '; ') AS words, CASE WHEN p_size > 20 THEN '1' ELSE '' END AS large, p_brand AS custom_brand, '' AS custom_other FROM part",
    "export_totals": "SELECT count(*) AS files, count(DISTINCT p_brand) AS albums, count(DISTINCT p_type) AS artists, sum(p_size)::BIGINT AS bytes, sum(p_size)::BIGINT AS seconds FROM part",
    "xml_text": f"SELECT conv_id, turn, sha256({_XML.format('text')}) AS text FROM {_C}",
    "template_rows": f"SELECT p_partkey, '<b>' || {_XML.format(_NAME)} || '</b> ' || p_brand || ' none of ' || p_size AS text FROM part",
    "template_document": "SELECT o_orderpriority, o_orderstatus, sha256('# list' || chr(10) || string_agg('- ' || o_orderkey || ': ' || floor(o_totalprice)::BIGINT || chr(10), '' ORDER BY o_orderkey) || 'end') AS content FROM orders GROUP BY 1, 2",
    "json_manifest": f"""SELECT conv_id, '{{"files":' || count(*) || ',"tracks":[' || string_agg('{{"turn":' || turn || ',"role":"' || role || '"}}', ',' ORDER BY turn, role) || ']}}' AS content FROM {_C} GROUP BY 1""",
    "m3u_block": rf"SELECT conv_id, sha256('#EXTM3U' || chr(10) || string_agg('#EXTINF:' || floor(length(text) / 10.0 + 0.5)::BIGINT || ',' || regexp_replace(role || ' - ' || text, '[\r\n]+', ' ', 'g') || chr(10) || '/' || role || '/' || turn || '.mp3', chr(10) ORDER BY turn, role, text) || chr(10)) AS content FROM {_C} GROUP BY 1",
    "pls_index": f"SELECT conv_id, sha256('[playlist]' || chr(10) || string_agg('File' || n || '=/' || role || chr(10) || 'Title' || n || '=' || role || chr(10) || 'Length' || n || '=-1', chr(10) ORDER BY n) || chr(10) || 'NumberOfEntries=' || count(*) || chr(10) || 'Version=2' || chr(10)) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM {_C}) GROUP BY 1",
    "xspf_list": f"""SELECT conv_id, sha256('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<playlist version="1" xmlns="http://xspf.org/ns/0/">' || chr(10) || '<trackList>' || chr(10) || string_agg('<track><location>/' || role || '</location><title>' || {_XML.format('text')} || '</title><duration>2500</duration></track>', chr(10) ORDER BY turn, role, text) || chr(10) || '</trackList>' || chr(10) || '</playlist>' || chr(10)) AS content FROM {_C} GROUP BY 1""",
    "row_index": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS index FROM orders",
    "sniff_bytes": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'flac' WHEN 1 THEN 'mp3' WHEN 2 THEN 'wav' WHEN 3 THEN 'ogg' WHEN 4 THEN 'm4a' WHEN 6 THEN 'aac' ELSE CASE WHEN doc_id % 2 = 0 THEN 'wma' END END AS format FROM documents",
    "trailer_tags": "SELECT p_partkey, CASE WHEN t THEN trim(left(p_name, 30)) END AS title, CASE WHEN t THEN p_brand END AS artist, CASE WHEN t THEN p_type END AS album, CASE WHEN t THEN '1999' END AS year, CASE WHEN t THEN 'note' END AS comment, CASE WHEN t THEN p_size::BIGINT END AS track FROM (SELECT *, p_partkey % 3 > 0 AS t FROM part)",
    "media_numbers": "SELECT p_partkey, 44100::BIGINT AS rate, 2::BIGINT AS channels, 16::BIGINT AS bits, p_partkey::DOUBLE AS seconds, p_size::BIGINT AS width, p_partkey AS height, greatest(floor(p_size * r + 0.5), 1)::INT AS thumb_w, greatest(floor(p_partkey * r + 0.5), 1)::INT AS thumb_h, true AS storable FROM (SELECT *, least(1.0::DOUBLE, 100::DOUBLE / greatest(p_size, p_partkey)) AS r FROM part)",
    "format_matrix": f"SELECT format, lossless, writable, count(page_id) AS n_rows FROM {tables.FORMATS_SQL} LEFT JOIN pages ON page_id % 7 = i GROUP BY 1, 2, 3",
    "release_json": "SELECT l_orderkey::VARCHAR AS id, CASE WHEN l_orderkey % 2 = 0 THEN 'A & B' ELSE 'C' END AS artists, CASE WHEN l_orderkey % 2 = 0 THEN 1998 ELSE 2001 END AS year, count(*) AS track_count, round(CASE WHEN l_orderkey % 2 = 0 THEN sum(l_quantity) ELSE sum(60 + l_linenumber) END, 3) AS seconds FROM lineitem GROUP BY l_orderkey",
    "search_texts": r"""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'barcode:"' || p_partkey || '"' ELSE 'artist:"' || p_brand || '" AND release:"' || p_name || ' \(x\)"' END AS query FROM part""",
}

_T = """(SELECT *, o_orderkey AS k, o_orderkey || '.mp3' AS name, '/music/' || o_orderpriority AS folder, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus || ', A & B' END AS artist, CASE WHEN o_orderkey % 4 > 0 THEN ' t' || chr(10) || '<' || o_orderkey || '> ' END AS title,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS album, CASE WHEN o_orderkey % 2 > 0 THEN o_custkey END AS number, CASE WHEN o_orderkey % 7 > 0 THEN floor(o_totalprice) / 4 END AS seconds, floor(o_totalprice)::BIGINT AS size FROM orders)"""
_LT = "trim(replace(coalesce(artist, 'Unknown Artist') || ' - ' || coalesce(title, k::VARCHAR), chr(10), ' '))"
_S = "floor(seconds + 0.5)::BIGINT"
ORACLE["m3u_lists"] = f"""SELECT o_custkey, sha256('#EXTM3U' || chr(10) || CASE WHEN arg_min(coalesce(artist, ''), k) = '' THEN '' ELSE '#PLAYLIST:' || arg_min(coalesce(artist, ''), k) || CASE WHEN arg_min(coalesce(album, ''), k) = '' THEN '' ELSE ' — ' || arg_min(coalesce(album, ''), k) END || chr(10) END || string_agg(e, chr(10) ORDER BY k) || chr(10)) AS content
FROM (SELECT *, '#EXTINF:' || coalesce({_S}, -1) || ',' || {_LT} || chr(10) || coalesce('#EXTALB:' || album || chr(10), '') || coalesce('#EXTTRACK:' || number || chr(10), '') || CASE WHEN seconds IS NOT NULL THEN '#EXTBYT:' || size || chr(10) ELSE '' END || folder || '/' || name AS e FROM {_T}) GROUP BY 1"""
ORACLE["m3u_plain"] = f"SELECT o_custkey, sha256(string_agg('../lists/' || name, chr(10) ORDER BY k) || chr(10)) AS content FROM {_T} GROUP BY 1"
ORACLE["pls_lists"] = f"""SELECT o_custkey, sha256('[playlist]' || chr(10) || string_agg('File' || n || '=' || ltrim(folder, '/') || '/' || name || chr(10) || 'Title' || n || '=' || {_LT} || coalesce(chr(10) || 'Length' || n || '=' || {_S}, ''), chr(10) ORDER BY k) || chr(10) || 'NumberOfEntries=' || count(*) || chr(10) || 'Version=2' || chr(10)) AS content
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS n FROM {_T}) GROUP BY 1"""
ORACLE["xspf_lists"] = f"""SELECT o_custkey, sha256('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<playlist version="1" xmlns="http://xspf.org/ns/0/">' || chr(10) || '  <title>' || arg_min(coalesce(album, 'Playlist'), k) || '</title>' || chr(10) || '  <creator>' || arg_min(coalesce({_XML.format('artist')}, 'Playlist'), k) || '</creator>' || chr(10) || '  <trackList>' || chr(10)
  || string_agg('    <track>' || chr(10) || '      <location>' || folder || '/' || name || '</location>' || chr(10) || coalesce('      <title>' || {_XML.format('title')} || '</title>' || chr(10), '') || coalesce('      <creator>' || {_XML.format('artist')} || '</creator>' || chr(10), '') || coalesce('      <album>' || album || '</album>' || chr(10), '')
  || coalesce('      <trackNum>' || number || '</trackNum>' || chr(10), '') || coalesce('      <duration>' || floor(seconds * 1000 + 0.5)::BIGINT || '</duration>' || chr(10), '') || '    </track>', chr(10) ORDER BY k) || chr(10) || '  </trackList>' || chr(10) || '</playlist>' || chr(10)) AS content FROM {_T} GROUP BY 1"""
_AR = "replace(coalesce(artist, ''), ', ', '; ')"
_TC = "coalesce('\"' || title || '\"', '')"
ORACLE["table_export"] = f"""SELECT o_orderkey, name || ',' || {_TC} || ',' || {_AR} || ',,' || coalesce(album, '') || ',' || coalesce(number::VARCHAR, '') || ',,,' || year(o_orderdate) || ',,,,,,mp3,' || coalesce({_S}::VARCHAR, '') || ',,,,,' || size || ',' || folder || ',,,,,' AS line,
  name || ';' || {_TC} || ';' || CASE WHEN artist IS NULL THEN '' ELSE '"' || {_AR} || '"' END || ';;' || coalesce(album, '') || ';' || coalesce(number::VARCHAR, '') || ';;;' || year(o_orderdate) || ';;;;;;;' AS basic FROM {_T}"""
_D = "o_custkey, count(*) AS n, {} AS body FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS i, replace(coalesce(artist, ''), ', ', '; ') AS a, coalesce(title, '') AS ti, coalesce(album, '') AS al, coalesce(number::VARCHAR, '') AS nu, coalesce(floor(seconds + 0.5)::BIGINT::VARCHAR, '') AS du FROM " + _T + ") GROUP BY 1"


def _report(name: str, head: str, line: str, tail: str) -> str:
    """SQL of a built-in report: what stands before the lines, each line, and what stands behind them. n is the count, i counts the lines."""
    own = line.replace("{ti}", _XML.format("ti")).replace("{a}", _XML.format("a"))
    return f"SELECT o_custkey, sha256({head} || body || {tail}) AS content, '{name}' AS template FROM (SELECT {_D.format(f'string_agg({own}, {chr(39) * 2} ORDER BY k)')})"


_NL = "chr(10)"
_REPORTS = [
    _report(
        "xml-manifest",
        f"""'<?xml version="1.0" encoding="UTF-8"?>' || {_NL} || '<catalog entries="' || n || '" written="2020-01-01 00:00:00">' || {_NL}""",
        f"""'  <entry number="' || i || '" seconds="' || du || '" container="mp3">' || {_NL} || '    <name>' || {{ti}} || '</name>' || {_NL} || '    <by>' || {{a}} || '</by>' || {_NL} || '    <from position="' || nu || '" released="' || year(o_orderdate) || '" kind="">' || al || '</from>' || {_NL} || '  </entry>' || {_NL}""",
        f"'</catalog>' || {_NL}",
    ),
    _report(
        "html-report",
        f"""'<!doctype html>' || {_NL} || '<meta charset="utf-8">' || {_NL} || '<title>' || n || ' recordings</title>' || {_NL} || '<h1>' || n || ' recordings</h1>' || {_NL} || '<ol>' || {_NL}""",
        f"'<li><cite>' || {{ti}} || '</cite> by ' || {{a}} || ', on <em>' || al || '</em> <small>' || du || ' s, mp3</small></li>' || {_NL}",
        f"'</ol>' || {_NL} || '<footer>written 2020-01-01 00:00:00</footer>' || {_NL}",
    ),
    _report("markdown-report", f"'# ' || n || ' recordings' || {_NL} || {_NL}", f"i || '. **' || ti || '** by ' || a || ', on *' || al || '* (' || du || ' s, mp3)' || {_NL}", f"{_NL} || 'Written 2020-01-01 00:00:00.' || {_NL}"),
    _report("rtf-report", f"'{{\\rtf1\\ansi{{\\fonttbl{{\\f0 Georgia;}}}}\\f0\\fs24 ' || n || ' recordings, written 2020-01-01 00:00:00\\par' || {_NL}", f"i || '\\tab ' || ti || ' / ' || a || ' / ' || du || ' s\\par' || {_NL}", "'}'"),
    _report("txt-report", "''", f"i || '. ' || ti || ' by ' || a || ' (' || al || ')' || {_NL}", "''"),
]
_JSON = "coalesce('\"{}\":' || {} || ',', '')"
_TRACK = " || ".join(
    [_JSON.format("title", "'\"' || replace(title, chr(10), '\\n') || '\"'"), _JSON.format("artist", "'\"' || replace(artist, ', ', '; ') || '\"'"), _JSON.format("album", "'\"' || album || '\"'"), _JSON.format("track", "number"), "'\"year\":' || year(o_orderdate) || ',\"format\":\"mp3\",'", _JSON.format("duration", _S), "'\"size\":' || size"]
)
_ALL = f"""SELECT o_custkey, sha256('{{"generator":"florile","exported":"2020-01-01 00:00:00","totals":{{"files":' || count(*) || ',"albums":' || count(DISTINCT album) || ',"artists":' || (count(DISTINCT CASE WHEN artist IS NOT NULL THEN o_orderstatus END) + CASE WHEN bool_or(artist IS NOT NULL) THEN 1 ELSE 0 END)
  || ',"bytes":' || sum(size)::BIGINT || '}},"tracks":[' || string_agg('{{"filename":"' || name || '",' || {_TRACK} || ',"folder":"' || folder || '"}}', ',' ORDER BY k) || ']}}') AS content, 'json-manifest' AS template FROM {_T} GROUP BY 1"""
_HEADER = "Filename,Title,Artist,Album Artist,Album,Track,Track Total,Disc,Year,Genre,Composer,BPM,Key,Comment,Format,Duration"
ORACLE["export_documents"] = " UNION ALL ".join(
    [f"SELECT o_custkey, sha256('{_HEADER}' || chr(13) || chr(10) || string_agg(name || ',' || {_TC} || ',' || {_AR} || ',,' || coalesce(album, '') || ',' || coalesce(number::VARCHAR, '') || ',,,' || year(o_orderdate) || ',,,,,,,', chr(13) || chr(10) ORDER BY k) || chr(13) || chr(10)) AS content, 'csv-basic' AS template FROM {_T} GROUP BY 1", _ALL, *_REPORTS]
)
ORACLE["manifest_totals"] = f"""SELECT o_custkey, '{{"generator":"florile","exported":"2020-01-01","totals":{{"files":' || count(*) || ',"albums":' || count(DISTINCT album) || ',"artists":' || (count(DISTINCT CASE WHEN artist IS NOT NULL THEN o_orderstatus END) + CASE WHEN bool_or(artist IS NOT NULL) THEN 1 ELSE 0 END) || ',"bytes":' || sum(size)::BIGINT || '}},"tracks":[' || string_agg('{{"key":' || k || '}}', ',' ORDER BY k) || ']}}' AS content FROM {_T} GROUP BY 1"""
ORACLE["image_sizes"] = """
SELECT p_partkey, mime, CASE WHEN k < 6 THEN p_size::BIGINT END AS width, CASE WHEN k < 6 THEN p_partkey % 5000 + 1 END AS height, mime = 'image/jpeg' AS in_mp4, mime IN ('image/jpeg', 'image/webp') AS elsewhere
FROM (SELECT *, p_partkey % 8 AS k, CASE WHEN p_partkey % 8 = 0 THEN 'image/gif' WHEN p_partkey % 8 = 1 THEN 'image/bmp' WHEN p_partkey % 8 < 5 THEN 'image/webp' WHEN p_partkey % 8 < 7 THEN 'image/jpeg' END AS mime FROM part)"""
ORACLE["wav_numbers"] = "SELECT p_partkey, CASE WHEN t THEN p_size::BIGINT % 8 + 1 END AS channels, CASE WHEN t THEN p_partkey * 10 END AS sample_rate, CASE WHEN t THEN p_size::BIGINT % 4 * 8 + 8 END AS bits FROM (SELECT *, p_partkey % 5 > 0 AS t FROM part)"
ORACLE["release_union"] = "SELECT 'c' || c_custkey AS id, c_name || ' feat. ' || c_mktsegment AS artist, c_nationkey AS year FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, NULL FROM supplier"
