"""Chunks in bytes: a walk along the lengths that RIFF, AIFF, FLAC, MP4, Ogg, Vorbis comments, ID3v2 and JPEG write before their parts.

walk follows lengths through BINARY in one expression: a fold whose state is the place to go on from, bounded by the content's length, so
it ends on any bytes. Chunks are read in blocks whose places are found first, so the time is linear in their number. A chunk is (id, start, length): a name, where its bytes begin, and how many there are. Chunks that claim more than there is end the walk.

Tags then are chunks of chunks: text_at reads one, children walks into one. Bytes of another container give no chunks.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binary import number, starts
from ..functions.text import once

#: Chunks that are folded together, and the fewest bytes that a chunk takes with what says its length.
BLOCK, LEAST = 64, 4
CHUNK = "struct<id:string,start:int,length:int>"

Step = Callable[[Column, Column, Column], Column]


def chunk(there: Column, id: Column, start: Column, length: Column, next_: Column) -> Column:
    """What a step gives: a chunk and where the walk goes on (under 0: nowhere), or null at the end."""
    return F.when(there, F.struct(id.cast("string").alias("id"), start.try_cast("int").alias("start"), length.try_cast("int").alias("length"), next_.try_cast("int").alias("next")))


def walk(content: Column, start: Column | int, end: Column, step: Step) -> Column:
    """An array of the chunks of content from start to end. step(content, at, end) says what stands at a place."""
    start = F.lit(start) if isinstance(start, int) else start
    none = F.array().cast(f"array<{CHUNK}>")

    def after(x: Column, at: Column) -> Column:
        return F.when(x.isNull() | (x["next"] <= at), -1).otherwise(x["next"])

    def skipped(c: Column, end: Column, at: Column) -> Column:
        """Where BLOCK chunks from at end."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), at, lambda at, _: F.when(at < 0, at).otherwise(once(step(c, at, end), lambda x: after(x, at))))

    def block(c: Column, end: Column, at: Column) -> Column:
        """BLOCK chunks from at."""

        def one(acc: Column) -> Column:
            own = lambda x: F.struct(x["id"].alias("id"), x["start"].alias("start"), x["length"].alias("length"))
            add = lambda x: F.struct(after(x, acc["at"]).alias("at"), F.when(x.isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(own(x)))).alias("found"))
            return F.when(acc["at"] < 0, acc).otherwise(once(step(c, acc["at"], end), add))

        return F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), F.struct(at.alias("at"), none.alias("found")), lambda acc, _: one(acc), lambda acc: acc["found"])

    def all_(x: Column) -> Column:
        c, start, end = x["c"], x["start"], x["end"]
        blocks = F.ceil(F.greatest(end - start, F.lit(0)) / (LEAST * BLOCK)).cast("int") + 1
        # A fold copies its state at each step, so what is folded is where blocks begin, and their chunks are read after that.
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("begins"))
        on = lambda acc: F.struct(skipped(c, end, acc["at"]).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins"))
        begins = F.aggregate(F.sequence(F.lit(1), blocks), begin, lambda acc, _: F.when(acc["at"] < 0, acc).otherwise(on(acc)), lambda acc: acc["begins"])
        return F.flatten(F.transform(begins, lambda at: block(c, end, at)))

    found = once(F.struct(content.alias("c"), start.cast("int").alias("start"), F.coalesce(end, F.octet_length(content)).cast("int").alias("end")), all_)
    return F.when(content.isNotNull() & (start >= 0), found).otherwise(none)


def latin(content: Column, at: Column, n: int | Column) -> Column:
    return F.decode(F.substring(content, at + 1, F.lit(n) if isinstance(n, int) else n), "ISO-8859-1")


def _sized(little: bool, even: bool) -> Step:
    def step(c: Column, at: Column, end: Column) -> Column:
        size = F.when(at + 8 <= end, number(c, at + 4, 4, little))
        return once(size, lambda n: chunk(n <= end - at - 8, latin(c, at, 4), at + 8, n, at + 8 + n + (n % 2 if even else 0)))

    return step


#: Chunks of RIFF and of AIFF: a name of four bytes, the length, and a byte more where that is odd.
riff, aiff = _sized(True, True), _sized(False, True)


def flac(c: Column, at: Column, end: Column) -> Column:
    """Metadata blocks: a byte with the last one's mark and the kind, three of length. The id is the kind's number."""
    head = F.when(at + 4 <= end, F.struct(number(c, at, 1).alias("kind"), number(c, at + 1, 3).alias("n")))
    return once(head, lambda h: chunk(h["n"] <= end - at - 4, h["kind"] % 128, at + 4, h["n"], F.when(h["kind"] >= 128, -1).otherwise(at + 4 + h["n"])))


#: Boxes of MP4 that hold the item list, and what stands in them before their first box.
HOLDERS = {"moov": 0, "udta": 0, "meta": 4}


def box(c: Column, at: Column, end: Column) -> Column:
    """Boxes of MP4: the length of all, a name; a length of 1 says that 8 more bytes have it, and 0 that it goes on to the end."""
    size = F.when(at + 8 <= end, number(c, at, 4))
    head = once(size, lambda n: F.when(n == 1, F.struct(F.lit(16).alias("head"), number(c, at + 8, 8).alias("all"))).otherwise(F.struct(F.lit(8).alias("head"), F.when(n == 0, end - at).otherwise(n).cast("long").alias("all"))))
    return once(head, lambda h: chunk((h["all"] >= h["head"]) & (h["all"] <= end - at), latin(c, at + 4, 4), at + h["head"], h["all"] - h["head"], at + h["all"]))


def inner_box(c: Column, at: Column, end: Column) -> Column:
    """Boxes, and behind one of HOLDERS those that it holds."""

    def into(x: Column) -> Column:
        skip = F.lit(None).cast("int")
        for name, n in HOLDERS.items():
            skip = F.when(x["id"] == name, x["start"] + n).otherwise(skip)
        return F.when(x.isNotNull(), F.struct(x["id"].alias("id"), x["start"].alias("start"), x["length"].alias("length"), F.coalesce(skip, x["next"]).alias("next")))

    return once(box(c, at, end), into)


def comment(c: Column, at: Column, end: Column) -> Column:
    """Entries of a Vorbis comment: a length and a text. The id is what stands before its first equals sign."""
    size = F.when(at + 4 <= end, number(c, at, 4, True))
    return once(size, lambda n: chunk(n <= end - at - 4, F.upper(F.substring_index(F.decode(F.substring(c, at + 5, n.try_cast("int")), "UTF-8"), "=", 1)), at + 4, n, at + 4 + n))


def page(c: Column, at: Column, end: Column) -> Column:
    """Pages of Ogg: a head of 27 bytes, a table of lengths and their parts. The id is the page's number."""
    parts = F.when((at + 27 <= end) & (latin(c, at, 4) == "OggS"), number(c, at + 26, 1))

    def body(n: Column) -> Column:
        table = F.hex(F.substring(c, at + 28, n.cast("int")))
        return F.aggregate(F.sequence(F.lit(0), n.cast("int")), F.lit(0), lambda acc, i: acc + F.coalesce(F.conv(F.substring(table, 2 * i + 1, F.lit(2)), 16, 10).try_cast("int"), F.lit(0)))

    head = once(parts, lambda n: F.when(n.isNotNull(), F.struct((at + 27 + n).alias("start"), body(n).alias("n"))))
    return once(head, lambda h: chunk(h["start"] + h["n"] <= end, number(c, at + 18, 4, True), h["start"], h["n"], h["start"] + h["n"]))


def id3_frames(synchsafe: bool) -> Step:
    """Frames of ID3v2.3, or of 2.4, whose lengths have seven bits a byte: a name, the length, two bytes of flags."""

    def step(c: Column, at: Column, end: Column) -> Column:
        size = F.when((at + 10 <= end) & latin(c, at, 4).rlike("^[A-Z0-9]{4}$"), synchsafe_number(c, at + 4) if synchsafe else number(c, at + 4, 4))
        return once(size, lambda n: chunk(n <= end - at - 10, latin(c, at, 4), at + 10, n, at + 10 + n))

    return step


def segment(c: Column, at: Column, end: Column) -> Column:
    """Segments of JPEG up to the picture's data. The id is the marker's number."""
    head = F.when(at + 4 <= end, F.struct(number(c, at, 2).alias("mark"), number(c, at + 2, 2).alias("n")))
    return once(head, lambda h: chunk((h["mark"] >= 0xFF00) & (h["n"] >= 2) & (h["mark"] != 0xFFDA), h["mark"], at + 4, h["n"] - 2, at + 2 + h["n"]))


def synchsafe_number(c: Column, at: Column) -> Column:
    parts = [F.shiftleft(number(c, at + k, 1).bitwiseAND(F.lit(127)), 7 * (3 - k)) for k in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def first(chunks: Column, id: str) -> Column:
    """The first chunk of a name; null without one."""
    return F.get(F.filter(chunks, lambda x: x["id"] == id), 0)


def children(content: Column, parent: Column, step: Step, skip: int = 0) -> Column:
    """The chunks in a chunk, behind its first skip bytes."""
    return once(parent, lambda p: walk(content, F.coalesce(p["start"] + skip, F.lit(-1)), p["start"] + p["length"], step))


def text_at(content: Column, own: Column, skip: int | Column = 0, charset: str = "UTF-8") -> Column:
    """A chunk's bytes behind the first skip, as text without the zeros at its end."""
    skip = F.lit(skip) if isinstance(skip, int) else skip
    return F.regexp_replace(F.decode(F.substring(content, own["start"] + skip + 1, F.greatest(own["length"] - skip, F.lit(0))), charset), r"\x00+$", "")


def _listed(content: Column, chunks: Column, name: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """name -> values, in order, of chunks whose name isn't null."""
    pairs = F.filter(F.transform(chunks, lambda x: F.struct(name(x).alias("k"), value(x).alias("v"))), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    return once(pairs, lambda ps: F.map_from_entries(F.transform(F.array_distinct(F.transform(ps, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.transform(F.filter(ps, lambda p: p["k"] == k), lambda p: p["v"]).alias("v")))))


def vorbis_comments(content: Column, own: Column, skip: int = 0) -> Column:
    """name -> values of a Vorbis comment in a chunk: a vendor, the number of entries, the entries. Names are in upper case; entries without a name go."""

    def entries(p: Column) -> Column:
        vendor = number(content, p["start"] + skip, 4, True)
        begin = (p["start"] + skip + 8 + vendor).try_cast("int")
        n = number(content, begin - 4, 4, True)
        found = once(walk(content, F.coalesce(begin, F.lit(-1)), p["start"] + p["length"], comment), lambda xs: F.slice(xs, F.lit(1), F.least(F.coalesce(n, F.lit(0)), F.size(xs)).try_cast("int")))
        raw = lambda x: F.decode(F.substring(content, x["start"] + 1, x["length"]), "UTF-8")
        return once(found, lambda xs: _listed(content, xs, lambda x: F.when(F.instr(raw(x), "=") > 1, x["id"]), lambda x: F.substring(raw(x), F.length(x["id"]) + 2, x["length"])))

    return once(own, entries)


def flac_tags(content: Column) -> Column:
    """name -> values of the Vorbis comment of a FLAC file, wherever among its blocks it stands; null for other bytes."""
    return once(content, lambda c: F.when(starts(c, b"fLaC"), vorbis_comments(c, first(walk(c, 4, F.octet_length(c), flac), "4"))))


def wav_tags(content: Column) -> Column:
    """name -> values of the INFO list of a WAV file, wherever it stands; null for other bytes."""

    def of(c: Column) -> Column:
        lists = F.filter(walk(c, 12, F.octet_length(c), riff), lambda x: (x["id"] == "LIST") & (latin(c, x["start"], 4) == "INFO"))
        return once(children(c, F.get(lists, 0), riff, 4), lambda xs: _listed(c, xs, lambda x: x["id"], lambda x: text_at(c, x, 0, "ISO-8859-1")))

    return once(content, lambda c: F.when(starts(c, b"RIFF") & starts(c, b"WAVE", 8), of(c)))


def wav_format(content: Column) -> Column:
    """(channels, sample_rate, bits, seconds) of a WAV file, whatever the order of its chunks."""

    def of(c: Column) -> Column:
        def read(xs: Column) -> Column:
            at, data = first(xs, "fmt ")["start"], first(xs, "data")["length"]
            row = F.struct(number(c, at + 2, 2, True).alias("channels"), number(c, at + 4, 4, True).alias("sample_rate"), number(c, at + 14, 2, True).alias("bits"))
            return once(row, lambda r: F.struct(r["channels"].alias("channels"), r["sample_rate"].alias("sample_rate"), r["bits"].alias("bits"), F.try_divide(data.cast("double"), r["sample_rate"] * r["channels"] * r["bits"] / 8).alias("seconds")))

        return once(walk(c, 12, F.octet_length(c), riff), read)

    return once(content, lambda c: F.when(starts(c, b"RIFF") & starts(c, b"WAVE", 8), of(c)))


def mp4_tags(content: Column) -> Column:
    """name -> values of the texts in the first item list of an MP4 file; null for other bytes."""

    def of(c: Column) -> Column:
        # An item begins with a data box: its length and name, a kind (1 is UTF-8), a language, the text.
        plain = lambda x: (latin(c, x["start"] + 4, 4) == "data") & (number(c, x["start"] + 8, 4) == 1)
        text = lambda x: F.decode(F.substring(c, x["start"] + 17, (F.least(number(c, x["start"], 4), x["length"]) - 16).try_cast("int")), "UTF-8")
        items = children(c, first(walk(c, 0, F.octet_length(c), inner_box), "ilst"), box)
        return once(items, lambda xs: _listed(c, xs, lambda x: F.when(plain(x), x["id"]), text))

    return once(content, lambda c: F.when(starts(c, b"ftyp", 4), of(c)))


def id3_tags(content: Column) -> Column:
    """name -> values of the text frames of an ID3v2.3 or 2.4 head; null for other bytes."""
    charsets = ("ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-8")

    def text(c: Column, x: Column) -> Column:
        kind, out = number(c, x["start"], 1), F.lit(None).cast("string")
        for k, charset in enumerate(charsets):
            out = F.when(kind == k, text_at(c, x, 1, charset)).otherwise(out)
        return out

    def of(c: Column, newest: bool) -> Column:
        end = 10 + synchsafe_number(c, F.lit(6))
        return once(walk(c, 10, F.least(end, F.octet_length(c)), id3_frames(newest)), lambda xs: _listed(c, xs, lambda x: F.when(F.startswith(x["id"], F.lit("T")) & (x["id"] != "TXXX"), x["id"]), lambda x: text(c, x)))

    return once(content, lambda c: F.when(starts(c, b"ID3") & (number(c, 3, 1) == 4), of(c, True)).when(starts(c, b"ID3") & (number(c, 3, 1) == 3), of(c, False)))


def ogg_tags(content: Column) -> Column:
    """name -> values of the comment that begins the second page of an Ogg Vorbis or Opus file, as far as it stands in that page; null for other bytes."""

    def of(c: Column) -> Column:
        second = F.get(walk(c, 0, F.octet_length(c), page), 1)
        return once(second, lambda p: F.when(latin(c, p["start"], 8) == "OpusTags", vorbis_comments(c, p, 8)).when(latin(c, p["start"] + 1, 6) == "vorbis", vorbis_comments(c, p, 7)))

    return once(content, lambda c: F.when(starts(c, b"OggS"), of(c)))
