"""Queries: tags in containers, read from bytes that are made from parts."""

from pyspark.sql import functions as F

from ..functions.binary import big, little, raw
from ..functions.text import once
from ..sources import chunks, files
from . import tables


def _parts(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 6)


def _in_order(k, parts):
    """The parts in one of six orders."""
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    return F.element_at(F.array(*[raw(*(parts[i] for i in o)) for o in orders]), (k + 1).cast("int"))


def _shown(tags):
    """name=value, value; name=value ... by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ", "))), "; ")


def _length(c):
    return F.octet_length(c.cast("binary"))


def _riff(id, body):
    return once(body, lambda b: raw(id, little(_length(b), 4), b, F.when(_length(b) % 2 == 1, F.lit(bytearray(1))).otherwise(F.lit(bytearray()))))


def wav_chunks(spark, sf_dir):
    """INFO lists and formats of WAV files whose chunks stand in any order, odd lengths filled up; some are no WAV, some claim more than they have."""
    p = _parts(spark, sf_dir)
    info = _riff("LIST", raw("INFO", _riff("INAM", raw(F.col("p_name"), b"\0")), _riff("IART", raw(F.col("p_brand"))), _riff("ICMT", raw(F.col("p_type"), b"\0\0"))))
    form = _riff("fmt ", raw(b"\x01\0", little(F.col("p_size") % 8 + 1, 2), little(F.col("p_partkey") + 8000, 4), b"\0" * 6, little(F.lit(16), 2)))
    body = raw("WAVE", _in_order(F.col("k"), (form, info, _riff("data", F.rpad(F.lit("x"), F.col("p_size") * 4, "y").cast("binary")))), F.when(F.col("p_partkey") % 5 == 0, raw("junk", little(F.lit(10**9), 4), "x")).otherwise(F.lit(bytearray())))
    content = once(body, lambda b: raw(F.when(F.col("p_partkey") % 7 == 0, raw("RIFX")).otherwise(raw("RIFF")), little(_length(b), 4), b))
    own = p.select("p_partkey", chunks.wav_format(content).alias("f"), _shown(chunks.wav_tags(content)).alias("tags"))
    return own.select("p_partkey", "f.channels", "f.sample_rate", "f.bits", F.round("f.seconds", 9).alias("seconds"), "tags")


def _comment(*entries):
    texts = [once(raw(*e) if isinstance(e, tuple) else raw(e), lambda t: raw(little(_length(t), 4), t)) for e in entries]
    return raw(little(F.lit(7), 4), "florile", little(F.lit(len(texts)), 4), *texts)


def _entries():
    return (("TITLE=", F.col("p_name")), ("artist=", F.col("p_brand")), "no equals sign", "=no name", ("Artist=", F.col("p_type")), ("COMMENT=a=", F.col("p_size").cast("string")))


def flac_comments(spark, sf_dir):
    """Comments of FLAC files among other blocks in any order, with names in any case and several values of one."""
    p = _parts(spark, sf_dir)
    body = _comment(*_entries())
    block = lambda kind, body, last=0: once(body, lambda b: raw(big(F.lit(kind + last), 1), big(_length(b), 3), b))
    blocks = _in_order(F.col("k"), (block(0, F.lit(bytearray(34))), block(4, body), block(1, F.rpad(F.lit("\0"), F.col("p_size"), "\0").cast("binary"))))
    content = raw(F.when(F.col("p_partkey") % 7 == 0, raw("flac")).otherwise(raw("fLaC")), blocks, block(6, F.lit(bytearray(b"picture")), 128), b"\xff\xf8 frames")
    return p.select("p_partkey", _shown(chunks.flac_tags(content)).alias("tags"))


def ogg_comments(spark, sf_dir):
    """Comments of the second page of Ogg files of two codecs."""
    p = _parts(spark, sf_dir)
    table = lambda b: raw(big(F.floor(_length(b) / 255) + 1, 1), F.unhex(F.repeat(F.lit("FF"), F.floor(_length(b) / 255).cast("int"))), big(_length(b) % 255, 1))
    page = lambda n, body: once(body, lambda b: raw("OggS", b"\0\0" + b"\0" * 8 + b"\x01\0\0\0", little(F.lit(n), 4), b"\0" * 4, table(b), b))
    opus = F.col("p_partkey") % 2 == 0
    body = raw(F.when(opus, raw("OpusTags")).otherwise(raw(b"\x03vorbis")), _comment(*_entries(), ("DESCRIPTION=", F.repeat("p_name", 40))))
    content = raw(page(0, F.when(opus, raw("OpusHead")).otherwise(raw(b"\x01vorbis"))), page(1, body), page(2, F.lit(bytearray(300))))
    return p.select("p_partkey", F.sha2(_shown(chunks.ogg_tags(F.when(F.col("p_partkey") % 7 > 0, content))), 256).alias("tags"))


def mp4_items(spark, sf_dir):
    """Texts of the item list, four boxes deep, beside boxes with long lengths; items of other kinds go."""
    p = _parts(spark, sf_dir)
    box = lambda id, *b: once(raw(*b), lambda x: raw(big(_length(x) + 8, 4), id, x))
    long = lambda id, *b: once(raw(*b), lambda x: raw(big(F.lit(1), 4), id, big(_length(x) + 16, 8), x))
    item = lambda id, text, kind=1: box(id, box("data", big(F.lit(kind), 4), b"\0" * 4, text))
    p = p.withColumn("items", box("ilst", _in_order(F.col("k"), (item(b"\xa9nam", F.col("p_name")), item(b"\xa9ART", F.col("p_brand")), item("covr", F.lit("pixels"), 13))), item(b"\xa9gen", F.col("p_type"))))
    p = p.withColumn("udta", box("udta", box("meta", b"\0" * 4, box("hdlr", b"\0" * 9), F.col("items"))))
    p = p.withColumn("moov", box("moov", box("mvhd", b"\0" * 20), F.col("udta")))
    content = raw(box("ftyp", "M4A \0\0\0\0"), _in_order(F.col("k"), (long("mdat", F.repeat(F.lit("m"), F.col("p_size"))), F.col("moov"), box("free"))))
    p = p.withColumn("content", F.when(F.col("p_partkey") % 7 == 0, raw("x", content)).otherwise(content))
    return p.select("p_partkey", _shown(chunks.mp4_tags(F.col("content"))).alias("tags"))


def id3_texts(spark, sf_dir):
    """Text frames of ID3v2.3 and 2.4 in three charsets, with padding behind them."""
    p = _parts(spark, sf_dir)
    seven = lambda n: F.shiftleft(F.shiftrightunsigned(n, 7).bitwiseAND(F.lit(127)), 8) + n.bitwiseAND(F.lit(127))
    newest = F.col("p_partkey") % 2 == 0
    size = lambda n: F.when(newest, big(seven(n), 4)).otherwise(big(n, 4))
    frame = lambda id, *b: once(raw(*b), lambda x: raw(id, size(_length(x)), b"\0\0", x))
    frames = _in_order(F.col("k"), (frame("TIT2", b"\x03", F.repeat("p_name", 20), b"\0"), frame("TPE1", b"\x01", F.encode("p_brand", "UTF-16")), frame("COMM", b"\x00eng\0", F.col("p_type"))))
    body = raw(frames, frame("TALB", b"\0", F.col("p_type")), b"\0" * 30)
    content = raw("ID3", F.when(newest, F.lit(bytearray(b"\x04\0\0"))).otherwise(F.lit(bytearray(b"\x03\0\0"))), once(body, lambda b: raw(big(seven(_length(b)), 4), b)), b"\xff\xfb audio")
    return p.select("p_partkey", _shown(chunks.id3_tags(F.when(F.col("p_partkey") % 7 > 0, content))).alias("tags"))


def jpeg_segments(spark, sf_dir):
    """Sizes of JPEG files whose frame stands behind as many as 500 segments of the part's own lengths."""
    p = _parts(spark, sf_dir)
    other = raw(b"\xff\xe1", big(F.col("p_size") + 2, 2), F.rpad(F.lit("\0"), F.col("p_size"), "\0"))
    many = F.unhex(F.repeat(F.hex(other), (F.col("p_partkey") % 501).cast("int")))
    frame = raw(b"\xff\xc0\x00\x11\x08", big(F.col("p_size"), 2), big(F.col("p_partkey") % 5000 + 1, 2), b"\x03" + b"\0" * 9)
    content = raw(b"\xff\xd8", b"\xff\xe0\x00\x04ab", many, F.when(F.col("p_partkey") % 7 > 0, frame).otherwise(F.lit(bytearray())), b"\xff\xda\x00\x02", frame)
    own = files.image_size(F.col("content"))
    return p.select("p_partkey", content.alias("content")).select("p_partkey", own.alias("s")).select("p_partkey", "s.mime", "s.width", "s.height")


QUERIES = {f.__name__: f for f in (wav_chunks, flac_comments, ogg_comments, mp4_items, id3_texts, jpeg_segments)}

_VORBIS = "'ARTIST=' || p_brand || ', ' || p_type || '; COMMENT=a=' || p_size || '; {}TITLE=' || p_name"
ORACLE = {
    "wav_chunks": """
SELECT p_partkey, CASE WHEN w THEN p_size % 8 + 1 END AS channels, CASE WHEN w THEN p_partkey + 8000 END AS sample_rate, CASE WHEN w THEN 16 END AS bits,
  CASE WHEN w THEN round(p_size * 4 / ((p_partkey + 8000) * (p_size % 8 + 1) * 2)::DOUBLE, 9) END AS seconds, CASE WHEN w THEN 'IART=' || p_brand || '; ICMT=' || p_type || '; INAM=' || p_name END AS tags
FROM (SELECT *, p_partkey % 7 > 0 AS w FROM part)""",
    "flac_comments": f"SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN {_VORBIS.format('')} END AS tags FROM part",
    "ogg_comments": f"SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN sha256({_VORBIS.format("DESCRIPTION=' || repeat(p_name, 40) || '; ")}) END AS tags FROM part",
    "mp4_items": "SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN '©ART=' || p_brand || '; ©gen=' || p_type || '; ©nam=' || p_name END AS tags FROM part",
    "id3_texts": "SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN 'TALB=' || p_type || '; TIT2=' || repeat(p_name, 20) || '; TPE1=' || p_brand END AS tags FROM part",
    "jpeg_segments": "SELECT p_partkey, 'image/jpeg' AS mime, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 5000 + 1 END AS width, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS height FROM part",
}
