"""Files as rows: a recursive scan with binaryFile, format by leading bytes, the ID3v1 trailer, image sizes and content hashes.

All of it is Column expressions over the bytes, so that what isn't asked for isn't computed, but for the walk along a JPEG's segments, which
goes through Arrow. Path, size and time filters are pushed into the scan. Bytes that don't fit a layout give nulls, never an error.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions.binary import number
from ..functions.binary import starts as _starts
from ..functions.text import extension_of, folder_of, name_of, once
from . import chunks

#: Containers, and whether tags can be read and written, images, chapters, lyrics and several values of a field be
#: stored, and the codec loses nothing.
FORMATS = (
    ("mp3", True, True, True, True, True, True, False),
    ("aac", True, True, False, False, True, False, False),
    ("m4a", True, True, True, True, True, True, False),
    ("m4b", True, True, True, True, True, True, False),
    ("mp4", True, True, True, True, True, True, False),
    ("ogg", True, True, True, False, True, True, False),
    ("opus", True, True, True, False, True, True, False),
    ("spx", True, True, True, False, False, True, False),
    ("flac", True, True, True, False, True, True, True),
    ("alac", True, True, True, True, True, True, True),
    ("wav", True, True, False, False, False, False, True),
    ("aiff", True, False, False, False, False, False, True),
    ("aif", True, False, False, False, False, False, True),
    ("aifc", True, False, False, False, False, False, True),
    ("ape", True, True, True, False, False, False, True),
    ("wma", True, False, True, False, False, False, False),
    ("mpc", True, True, True, False, False, True, False),
    ("wv", True, True, True, False, False, True, True),
    ("tta", True, True, True, False, False, True, True),
    ("tak", True, False, True, False, False, False, True),
    ("ofr", True, True, True, False, False, True, True),
    ("ofs", True, True, True, False, False, True, True),
    ("wvp", True, True, True, False, False, True, True),
    ("mkv", False, False, False, True, False, False, False),
    ("mka", False, False, False, False, False, False, False),
    ("webm", False, False, False, False, False, False, False),
    ("dsf", True, False, False, False, False, False, True),
    ("dff", True, False, False, False, False, False, True),
)


def formats(spark: SparkSession) -> DataFrame:
    """The dimension of formats: a fixed table of 28 rows."""
    return spark.createDataFrame(list(FORMATS), "format string, readable boolean, writable boolean, artwork boolean, chapters boolean, lyrics boolean, multi_value boolean, lossless boolean")


def scan(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """path, folder, name, extension, size, modified_ms and content of the files below path. Spark leaves out files of 0 bytes."""
    glob = "*.{" + ",".join(extensions or [f[0] for f in FORMATS]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return described(files)


def described(files: DataFrame) -> DataFrame:
    """The columns of scan, of any table with path, length, modificationTime and content."""
    name = name_of(F.col("path"))
    return files.select("path", folder_of(F.col("path")).alias("folder"), name.alias("name"), extension_of(name).alias("extension"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), "content")


def sniff(content: Column, name: Column) -> Column:
    """The container by its leading bytes, in the order that tells them apart; else by extension; else null."""
    ext = extension_of(name)
    known = [f[0] for f in FORMATS]
    head = F.hex(F.substring(content, 1, 2))
    brand = F.substring(content, 9, 4)
    ogg = F.substring(content, 1, 64)
    holds = lambda b, t: F.contains(F.hex(b), F.lit(t.encode().hex().upper()))
    return (
        F.when(_starts(content, b"fLaC"), "flac")
        .when(_starts(content, b"OggS"), F.when(holds(ogg, "OpusHead"), "opus").when(holds(ogg, "Speex"), "spx").otherwise("ogg"))
        .when(_starts(content, b"RIFF") & _starts(content, b"WAVE", 8), "wav")
        .when(_starts(content, b"FORM") & (_starts(content, b"AIFF", 8) | _starts(content, b"AIFC", 8)), "aiff")
        .when(_starts(content, b"ftyp", 4), F.when(F.decode(brand, "ISO-8859-1").rlike("^M4[AB]"), "m4a").otherwise("mp4"))
        .when(_starts(content, b"MAC "), "ape")
        .when(_starts(content, b"wvpk"), "wv")
        .when(_starts(content, b"MPCK") | _starts(content, b"MP+"), "mpc")
        .when(_starts(content, b"OFR "), "ofr")
        .when(_starts(content, b"tBaK"), "tak")
        .when(_starts(content, b"TTA1"), "tta")
        .when(_starts(content, b"DSD "), "dsf")
        .when(_starts(content, bytes.fromhex("3026B2758E66CF11")), "wma")
        .when(head.isin("FFF1", "FFF9"), "aac")
        .when(_starts(content, b"ID3") | head.rlike("^FF[EF][2-7A-F]"), "mp3")
        .otherwise(F.when(ext.isin(known), ext))
    )


def id3v1(content: Column) -> dict[str, Column]:
    """title, artist, album, year, comment and track of the 128 bytes at the end; nulls without them."""
    size = F.octet_length(content)
    tail = F.substring(content, size - 127, F.lit(128))
    there = (size >= 128) & _starts(tail, b"TAG")
    text = lambda at, n: F.when(there, F.nullif(F.trim(F.regexp_replace(F.decode(F.substring(tail, at + 1, n), "ISO-8859-1"), "\\x00.*$", "")), F.lit("")))
    track = F.when(there & (number(tail, 125, 1) == 0), F.nullif(number(tail, 126, 1), F.lit(0)))
    return {"title": text(3, 30), "artist": text(33, 30), "album": text(63, 30), "year": text(93, 4), "comment": text(97, 28), "track": track}


def flac_properties(content: Column) -> dict[str, Column]:
    """Sample rate, channels, bits and seconds of FLAC's STREAMINFO."""
    there = _starts(content, b"fLaC")
    rate, rest = F.when(there, F.shiftrightunsigned(number(content, 18, 3), 4)), number(content, 20, 2)
    samples = number(content, 21, 5).bitwiseAND(F.lit(0xFFFFFFFFF))
    return {"sample_rate": rate, "channels": F.when(there, F.shiftrightunsigned(rest, 9).bitwiseAND(F.lit(7)) + 1), "bits": F.when(there, F.shiftrightunsigned(rest, 4).bitwiseAND(F.lit(31)) + 1), "seconds": F.try_divide(samples.cast("double"), rate)}


def wav_properties(content: Column) -> dict[str, Column]:
    """Channels, sample rate and bits of a WAV file, whatever the order of its chunks."""
    own = chunks.wav_format(content)
    return {k: own[k] for k in ("channels", "sample_rate", "bits")}


#: JPEG markers of frames, which say the size: C0 to CF but those of tables (C4, C8, CC).
FRAMES = [0xFFC0 + k for k in range(16) if k not in (4, 8, 12)]


def jpeg_size(content: Column, plain: bool = False) -> Column:
    """(width, height) of the first frame, however many segments stand before it; nulls without one.

    Segments are followed by batches of rows. plain: by expressions alone, which may stand in a lambda function, and take hundreds of times as long where segments are many.
    """
    if not plain:
        return arrow.frame_size(content, FRAMES)

    def of(c: Column) -> Column:
        frame = F.get(F.filter(chunks.walk(c, 2, F.octet_length(c), chunks.segment), lambda x: x["id"].isin([str(k) for k in FRAMES])), 0)
        return once(frame, lambda x: F.struct(number(c, x["start"] + 3, 2).alias("width"), number(c, x["start"] + 1, 2).alias("height")))

    return once(content, of)


def webp_size(content: Column) -> tuple[Column, Column]:
    """Width and height of the three kinds of WebP: extended, lossless and lossy."""
    kind = F.decode(F.substring(content, 13, 4), "ISO-8859-1")
    bits = number(content, 21, 4, True)
    low = lambda c, n: c.bitwiseAND(F.lit((1 << n) - 1))
    width = F.when(kind == "VP8X", number(content, 24, 3, True) + 1).when(kind == "VP8L", low(bits, 14) + 1).when(kind == "VP8 ", low(number(content, 26, 2, True), 14))
    height = F.when(kind == "VP8X", number(content, 27, 3, True) + 1).when(kind == "VP8L", low(F.shiftrightunsigned(bits, 14), 14) + 1).when(kind == "VP8 ", low(number(content, 28, 2, True), 14))
    return width, height


def image_size(content: Column, plain: bool = False) -> Column:
    """(mime, width, height) of PNG, GIF, BMP, WebP and JPEG bytes; null for others. plain: as in jpeg_size."""
    row = lambda m, w, h: F.struct(F.lit(m).alias("mime"), w.alias("width"), h.alias("height"))
    jpeg = _starts(content, b"\xff\xd8\xff")
    frame = jpeg_size(F.when(jpeg, content), plain)

    def of(c: Column) -> Column:
        out = F.when(_starts(c, b"\x89PNG\r\n\x1a\n"), row("image/png", number(c, 16, 4), number(c, 20, 4))).when(_starts(c, b"GIF8"), row("image/gif", number(c, 6, 2, True), number(c, 8, 2, True)))
        return out.when(_starts(c, b"BM"), row("image/bmp", number(c, 18, 4, True), number(c, 22, 4, True))).when(_starts(c, b"RIFF") & _starts(c, b"WEBP", 8), row("image/webp", *webp_size(c)))

    # All but JPEG say their size in the first 30 bytes.
    return F.when(jpeg, row("image/jpeg", frame["width"], frame["height"])).otherwise(once(F.substring(content, 1, 30), of))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def scaled(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """The size whose long edge is longest at most, never larger than before and never under 1."""
    ratio = F.least(F.lit(1.0), longest / F.greatest(width, height))
    return F.greatest(F.floor(width * ratio + 0.5), F.lit(1)).cast("int"), F.greatest(F.floor(height * ratio + 0.5), F.lit(1)).cast("int")


def storable(mime: Column, container: Column) -> Column:
    """MP4 takes JPEG and PNG, others WebP too."""
    plain = mime.isin("image/jpeg", "image/jpg", "image/png")
    return F.when(container.isin("mp4", "m4a"), plain).otherwise(plain | (mime == "image/webp"))
