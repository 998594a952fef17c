"""Playlists: M3U, PLS and XSPF lines of rows, and the documents made of them."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up, stem_of, trim, xml_escape
from ..operators.stats import numbered
from .exports import joined


def track_path(folder: Column, name: Column, base: bool = False) -> Column:
    """/folder/name; with a base (a relative list beside its files), the name alone."""
    if base:
        return name
    whole = F.concat(F.lit("/"), F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), name)
    return F.regexp_replace(whole, "/+", "/")


def shown_title(artist: Column, title: Column, name: Column) -> Column:
    """artist - title, or what of it is there, or the name; on one line."""
    artist, title = F.nullif(artist, F.lit("")), F.nullif(title, F.lit(""))
    return F.regexp_replace(F.coalesce(F.concat(artist, F.lit(" - "), title), title, name), r"[\r\n]+", " ")


def m3u_entry(title: Column, seconds: Column, path: Column, album: Column | None = None, size: Column | None = None) -> Column:
    length = F.coalesce(half_up(seconds).cast("string"), F.lit("-1"))
    lines = [F.concat(F.lit("#EXTINF:"), length, F.lit(","), title)]
    if album is not None:
        lines.append(F.when(album != "", F.concat(F.lit("#EXTALB:"), album)))
    if size is not None:
        lines.append(F.concat(F.lit("#EXTBYT:"), size.cast("string")))
    return F.concat_ws("\n", *lines, path)


def m3u(rows: DataFrame, by: list[str], order: list[Column], entry: Column) -> DataFrame:
    body = joined(rows, by, order, entry, "\n", "body")
    return body.select(*by, F.concat(F.lit("#EXTM3U\n"), F.col("body"), F.lit("\n")).alias("content"))


def pls(rows: DataFrame, by: list[str], order: list[Column], title: Column, seconds: Column, path: Column) -> DataFrame:
    own = numbered(rows.withColumns({"_title": title, "_seconds": F.coalesce(half_up(seconds).cast("string"), F.lit("-1")), "_path": path}), by, order, "_n")
    n = F.col("_n").cast("string")
    entry = F.concat(F.lit("File"), n, F.lit("="), F.col("_path"), F.lit("\nTitle"), n, F.lit("="), F.col("_title"), F.lit("\nLength"), n, F.lit("="), F.col("_seconds"))
    body = joined(own, by, [F.col("_n")], entry, "\n", "body")
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return body.join(counts, by).select(*by, F.concat(F.lit("[playlist]\n"), F.col("body"), F.lit("\nNumberOfEntries="), F.col("n").cast("string"), F.lit("\nVersion=2\n")).alias("content"))


def xspf(rows: DataFrame, by: list[str], order: list[Column], title: Column, seconds: Column, path: Column) -> DataFrame:
    millis = F.when(seconds.isNotNull(), F.concat(F.lit("<duration>"), half_up(seconds * 1000).cast("string"), F.lit("</duration>")))
    entry = F.concat(F.lit("<track><location>"), xml_escape(path), F.lit("</location><title>"), xml_escape(title), F.lit("</title>"), F.coalesce(millis, F.lit("")), F.lit("</track>"))
    body = joined(rows, by, order, entry, "\n", "body")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<playlist version="1" xmlns="http://xspf.org/ns/0/">\n<trackList>\n'
    return body.select(*by, F.concat(F.lit(head), F.col("body"), F.lit("\n</trackList>\n</playlist>\n")).alias("content"))


@dataclass(frozen=True)
class Track:
    """Columns of a row that lists say something about: artists is an array, the others are single values, any of them null where absent."""

    folder: Column
    name: Column
    artists: Column
    title: Column
    album: Column
    number: Column
    seconds: Column
    size: Column


def list_path(t: Track, absolute: bool = True, base: str = "") -> Column:
    """/folder/name; relative: folder/name or, with a base folder, base/name."""
    full = F.regexp_replace(F.concat(t.folder, F.lit("/"), t.name), "^/+", "")
    if absolute:
        return F.concat(F.lit("/"), full)
    return F.concat(F.lit(base.rstrip("/") + "/"), t.name) if base.rstrip("/") else full


def one_line(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"\r?\n", " "))


def list_title(t: Track) -> Column:
    """artists - title, with a stand-in for either: "Unknown Artist" and the name without its extension."""
    return one_line(F.concat(F.coalesce(F.array_join(t.artists, ", "), F.lit("Unknown Artist")), F.lit(" - "), F.coalesce(t.title, stem_of(t.name))))


def first_row(t: Track, order: list[Column]) -> Column:
    """The artists and the album of a list's first row, an aggregate named first. The smallest row of a group is kept, so no group is sorted or gathered for it."""
    return F.min_by(F.struct(F.array_join(t.artists, ", ").alias("artist"), t.album.alias("album")), F.struct(*order)).alias("first")


def _with_first(rows: DataFrame, by: list[str], order: list[Column], t: Track, body: DataFrame) -> DataFrame:
    return body.join(rows.groupBy(*by).agg(first_row(t, order)), by)


def m3u_parts(t: Track, absolute: bool = True, base: str = "", extended: bool = True) -> tuple[Column, Column]:
    """What stands before an extended list, of first, and what each row has."""
    tag = lambda name, c: F.concat(F.lit(f"#{name}:"), c.cast("string"))
    length = F.coalesce(half_up(t.seconds).cast("string"), F.lit("-1"))
    about = [F.concat(F.lit("#EXTINF:"), length, F.lit(","), list_title(t)), F.when(t.album != "", tag("EXTALB", one_line(t.album))), tag("EXTTRACK", t.number), F.when(t.seconds.isNotNull(), tag("EXTBYT", t.size))]
    album = F.when(F.col("first.album") != "", F.concat(F.lit(" — "), F.col("first.album"))).otherwise("")
    head = F.when(F.col("first.artist") != "", tag("PLAYLIST", one_line(F.concat(F.col("first.artist"), album))))
    return F.concat_ws("\n", F.lit("#EXTM3U"), head), F.concat_ws("\n", *(about if extended else []), list_path(t, absolute, base))


def m3u_list(rows: DataFrame, by: list[str], order: list[Column], t: Track, absolute: bool = True, base: str = "", extended: bool = True) -> DataFrame:
    """M3U lists. extended: with a header that names the first row's artist and album, and each row's length, title, album, number and size."""
    head, line = m3u_parts(t, absolute, base, extended)
    body = joined(rows, by, order, line, "\n", "body")
    if not extended:
        return body.select(*by, F.concat(F.col("body"), F.lit("\n")).alias("content"))
    return _with_first(rows, by, order, t, body).select(*by, F.concat(F.concat_ws("\n", head, F.col("body")), F.lit("\n")).alias("content"))


def pls_lines(number: Column, title: Column, seconds: Column, path: Column) -> Column:
    """What a row of a list has; a row without a length has no line for it."""
    line = lambda name, c: F.concat(F.lit(name), number.cast("string"), F.lit("="), c)
    return F.concat_ws("\n", line("File", path), line("Title", title), line("Length", seconds))


def pls_columns(t: Track, absolute: bool = True, base: str = "") -> dict[str, Column]:
    return {"_title": list_title(t), "_seconds": half_up(t.seconds).cast("string"), "_path": list_path(t, absolute, base)}


def pls_list(rows: DataFrame, by: list[str], order: list[Column], t: Track, absolute: bool = True, base: str = "") -> DataFrame:
    """PLS lists; a row without a length has no line for it."""
    own = numbered(rows.withColumns(pls_columns(t, absolute, base)), by, order, "_n")
    body = joined(own, by, [F.col("_n")], pls_lines(F.col("_n"), F.col("_title"), F.col("_seconds"), F.col("_path")), "\n", "body")
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return body.join(counts, by).select(*by, F.concat(F.lit("[playlist]\n"), F.col("body"), F.lit("\nNumberOfEntries="), F.col("n").cast("string"), F.lit("\nVersion=2\n")).alias("content"))


def xspf_parts(t: Track, absolute: bool = True, base: str = "") -> tuple[Column, Column, str]:
    """What stands before a list, of first, what each row has, and what stands after it."""
    element = lambda name, c, some: F.when(some, F.concat(F.lit(f"      <{name}>"), c, F.lit(f"</{name}>")))
    creator = trim(F.array_join(t.artists, ", "))
    parts = [
        F.lit("    <track>"), F.concat(F.lit("      <location>"), xml_escape(list_path(t, absolute, base)), F.lit("</location>")), element("title", xml_escape(t.title), t.title != ""), element("creator", xml_escape(creator), creator != ""),
        element("album", xml_escape(t.album), t.album != ""), element("trackNum", t.number.cast("string"), t.number.isNotNull()), element("duration", half_up(t.seconds * 1000).cast("string"), t.seconds.isNotNull()), F.lit("    </track>"),
    ]
    own = lambda c: xml_escape(F.coalesce(F.col(c), F.lit("Playlist")))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<playlist version="1" xmlns="http://xspf.org/ns/0/">\n  <title>'), own("first.album"), F.lit("</title>\n  <creator>"), own("first.artist"), F.lit("</creator>\n  <trackList>"))
    return head, F.concat_ws("\n", *parts), "  </trackList>\n</playlist>"


def xspf_document(rows: DataFrame, by: list[str], order: list[Column], t: Track, absolute: bool = True, base: str = "") -> DataFrame:
    """XSPF lists, titled after the first row's album and artists; of a row, what is there."""
    head, line, tail = xspf_parts(t, absolute, base)
    body = joined(rows, by, order, line, "\n", "body")
    return _with_first(rows, by, order, t, body).select(*by, F.concat(head, F.lit("\n"), F.col("body"), F.lit("\n" + tail + "\n")).alias("content"))
