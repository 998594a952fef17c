"""Exports: CSV lines, flat rows, manifests and templates with a block for each row."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell, xml_escape
from ..operators.stats import numbered

#: Escaping by target format; a template of another format escapes nothing.
ESCAPES = {"html": xml_escape, "xml": xml_escape, "csv": csv_cell, "rtf": lambda c: F.regexp_replace(c, r"([\\{}])", r"\\$1"), "markdown": lambda c: F.regexp_replace(c, r"([|*_`\[\]])", r"\\$1")}


def flat(rows: DataFrame, custom: str | None = None, custom_keys: list[str] | None = None) -> DataFrame:
    """Lists joined by "; ", flags as "1" or "", absent values as "", keys of the custom map as custom_<key> columns."""
    out: list[Column] = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        if name == custom:
            continue
        if kind.startswith("array"):
            c = F.array_join(c, "; ")
        elif kind == "boolean":
            c = F.when(c, "1").otherwise("")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    for k in custom_keys or []:
        out.append(F.coalesce(F.try_element_at(F.col(custom), F.lit(k)), F.lit("")).alias(f"custom_{k}"))
    return rows.select(*out)


def csv_line(columns: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *(csv_cell(c, delimiter) for c in columns))


def write_csv(rows: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """Quoted where needed, lines ended by CR LF, a header in each part file."""
    flat(rows).write.mode(mode).option("header", True).option("sep", delimiter).option("lineSep", "\r\n").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_preview(before: DataFrame, after: DataFrame, id: str, delimiter: str = ",") -> DataFrame:
    """What a write of after over before would change, without writing: id, the line's bytes before and after (null where there is none). Rows that stay the same are left out."""
    line = lambda d, name: flat(d).select(F.col(id), csv_line([F.col(f"`{c}`") for c in d.columns], delimiter).alias(name))
    # Ids keep their type: flat makes texts of the others alone.
    own = [line(d, name).withColumn(id, F.col(id).cast(d.schema[id].dataType)) for d, name in ((before, "_was"), (after, "_is"))]
    met = own[0].join(own[1], id, "full").where(~F.col("_was").eqNullSafe(F.col("_is")))
    return met.select(id, F.octet_length("_was").alias("bytes_before"), F.octet_length("_is").alias("bytes_after"))


def write_lines(lines: DataFrame, column: str, order: list[Column], path: str, header: str | None = None, mode: str = "errorifexists") -> None:
    """A sorted text file in parts, in the order of their names; the header is a row before all others."""
    body = lines.select(F.col(column).alias("value"), F.lit(1).alias("_part"), *[o.alias(f"_k{i}") for i, o in enumerate(order)])
    if header is not None:
        body = body.unionByName(lines.sparkSession.createDataFrame([(header, 0)], "value string, _part int"), allowMissingColumns=True)
    body.orderBy("_part", *[f"_k{i}" for i in range(len(order))]).select("value").write.mode(mode).text(path)


def totals(rows: DataFrame, size: str, duration: str, album: str, artist: str) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.count_distinct(album).alias("albums"), F.count_distinct(artist).alias("artists"), F.sum(size).alias("bytes"), F.sum(duration).alias("seconds"))


PLACE = re.compile(r"\{\{\{(\w+)\}\}\}|\{\{\^(\w+)\}\}(.*?)\{\{/\2\}\}|\{\{(\w+)\}\}", re.S)


def rendered(template: str, fields: dict[str, Column], kind: str = "txt") -> Column:
    """One row's text: {{name}} is escaped for the kind, {{{name}}} is not, {{^name}}...{{/name}} shows where the value is empty."""
    known = {k.lower(): F.coalesce(c.cast("string"), F.lit("")) for k, c in fields.items()}
    escape = ESCAPES.get(kind, lambda c: c)
    out: list[Column] = []
    at = 0
    for m in PLACE.finditer(template):
        out.append(F.lit(template[at : m.start()]))
        name = (m[1] or m[2] or m[4]).lower()
        value = known.get(name, F.lit(""))
        if m[2]:
            out.append(F.when(value == "", rendered(m[3], fields, kind)).otherwise(""))
        else:
            out.append(value if m[1] else escape(value))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def block_template(template: str) -> tuple[str, str, str]:
    """What stands before, in and after {{#tracks}}...{{/tracks}}."""
    m = re.search(r"\{\{#tracks\}\}(.*?)\{\{/tracks\}\}", template, re.S)
    return (template, "", "") if m is None else (template[: m.start()], m[1], template[m.end() :])


def joined(rows: DataFrame, by: list[str], order: list[Column], line: Column, separator: str = "\n", name: str = "content") -> DataFrame:
    """For each group, its lines in order. A document is one value, so a group is as large as the document it makes."""
    keyed = rows.select(*by, F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], line.alias("line")).alias("x"))
    return keyed.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), separator).alias(name))


def render_document(rows: DataFrame, by: list[str], order: list[Column], template: str, fields: dict[str, Column], kind: str = "txt") -> DataFrame:
    """For each group, the template with its block repeated for each row; placeholders outside the block show nothing of rows."""
    head, block, tail = block_template(template)
    body = joined(rows, by, order, rendered(block, fields, kind), "", "body")
    return body.select(*by, F.concat(rendered(head, {}, kind), F.col("body"), rendered(tail, {}, kind)).alias("content"))


def manifest(rows: DataFrame, by: list[str], order: list[Column], track: Column) -> DataFrame:
    """For each group, a JSON text with the count and its tracks in order."""
    body = joined(rows, by, order, F.to_json(track), ",", "body")
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return body.join(counts, by).select(*by, F.concat(F.lit('{"files":'), F.col("n").cast("string"), F.lit(',"tracks":['), F.col("body"), F.lit("]}")).alias("content"))


#: The columns of a table export, label and key; without technical ones, the first BASIC of them.
COLUMNS = (
    ("Filename", "filename"), ("Title", "title"), ("Artist", "artist"), ("Album Artist", "albumartist"), ("Album", "album"), ("Track", "track"), ("Track Total", "tracktotal"), ("Disc", "disc"), ("Year", "year"),
    ("Genre", "genre"), ("Composer", "composer"), ("BPM", "bpm"), ("Key", "key"), ("Comment", "comment"), ("Format", "format"), ("Duration", "duration"), ("Bitrate", "bitrate"), ("Sample Rate", "samplerate"),
    ("Channels", "channels"), ("Bit Depth", "bitdepth"), ("File Size", "size"), ("Folder", "folder"), ("ISRC", "isrc"), ("Barcode", "barcode"), ("Catalog Number", "catalog"), ("Modified", "modified"), ("Tag Status", "tagstatus"),
)
BASIC = 16
#: Built-in templates by id: what escapes their values, and the text.
TEMPLATES = {
    "xml-manifest": (
        "xml",
        """<?xml version="1.0" encoding="UTF-8"?>
<catalog entries="{{count}}" written="{{exported}}">
{{#tracks}}  <entry number="{{index}}" seconds="{{duration}}" container="{{format}}">
    <name>{{title}}</name>
    <by>{{artist}}</by>
    <from position="{{track}}" released="{{year}}" kind="{{genre}}">{{album}}</from>
  </entry>
{{/tracks}}</catalog>
""",
    ),
    "html-report": (
        "html",
        """<!doctype html>
<meta charset="utf-8">
<title>{{count}} recordings</title>
<h1>{{count}} recordings</h1>
<ol>
{{#tracks}}<li><cite>{{title}}</cite> by {{artist}}, on <em>{{album}}</em> <small>{{duration}} s, {{format}}</small></li>
{{/tracks}}</ol>
<footer>written {{exported}}</footer>
""",
    ),
    "markdown-report": ("markdown", "# {{count}} recordings\n\n{{#tracks}}{{index}}. **{{title}}** by {{artist}}, on *{{album}}* ({{duration}} s, {{format}})\n{{/tracks}}\nWritten {{exported}}.\n"),
    "rtf-report": ("rtf", "{\\rtf1\\ansi{\\fonttbl{\\f0 Georgia;}}\\f0\\fs24 {{count}} recordings, written {{exported}}\\par\n{{#tracks}}{{index}}\\tab {{title}} / {{artist}} / {{duration}} s\\par\n{{/tracks}}}"),
    "txt-report": ("txt", "{{#tracks}}{{index}}. {{title}} by {{artist}} ({{album}})\n{{/tracks}}"),
}
TABLES, MANIFEST = ("csv-all", "csv-basic"), "json-manifest"


def table_header(technical: bool = True, delimiter: str = ",") -> str:
    return delimiter.join(label for label, _ in (COLUMNS if technical else COLUMNS[:BASIC]))


def table_line(fields: dict[str, Column], technical: bool = True, delimiter: str = ",") -> Column:
    """A row's line of a table export, of fields by key; those that are not given are empty. Technical ones (from format on) are empty too if they are not asked for."""
    keys = [k for _, k in (COLUMNS if technical else COLUMNS[:BASIC])]
    own = {k for _, k in COLUMNS[: BASIC - 2]} | {"isrc", "barcode", "catalog"}
    return csv_line([fields.get(k, F.lit("")) if technical or k in own else F.lit("") for k in keys], delimiter)


def library_manifest(rows: DataFrame, by: list[str], order: list[Column], track: Column, album: Column, artists: Column, size: Column, exported: str, generator: str = "florile") -> DataFrame:
    """For each group, a JSON text with the generator, the time of export, totals (files, albums, artists, bytes) and the tracks in order."""
    body = joined(rows, by, order, F.to_json(track), ",", "body")
    names = rows.select(*by, F.explode(artists).alias("artist")).groupBy(*by).agg(F.count_distinct("artist").alias("artists"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("files"), F.count_distinct(F.when(album != "", album)).alias("albums"), F.sum(size).alias("bytes"))
    totals = F.to_json(F.struct("files", "albums", F.coalesce("artists", F.lit(0)).alias("artists"), "bytes"))
    head = F.to_json(F.struct(F.lit(generator).alias("generator"), F.lit(exported).alias("exported")))
    out = body.join(sums, by).join(names, by, "left")
    return out.select(*by, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"totals":'), totals, F.lit(',"tracks":['), F.col("body"), F.lit("]}")).alias("content"))


def export(rows: DataFrame, by: list[str], order: list[Column], fields: dict[str, Column], template: str | None, exported: str, technical: bool = True, delimiter: str = ",", text: str | None = None, artists: Column | None = None) -> DataFrame:
    """For each group, a document by a built-in template's id, or (template None) by a template of one's own, text, which escapes nothing.

    "csv-all" and "csv-basic" are tables with their header, "json-manifest" is library_manifest with all fields of each track; its artists are
    those of artists, or what stands between the artist field's semicolons. In templates, {{count}}, {{exported}} and {{delimiter}} say what they
    say outside the block too, and {{index}} counts a group's rows. Other ids are errors.
    """
    if (template is None) == (text is None):
        raise ValueError("either a built-in template's id or a text is needed")
    if template is not None and template not in (*TABLES, MANIFEST, *TEMPLATES):
        raise ValueError(f"{template} is no built-in template; they are {', '.join((*TABLES, MANIFEST, *TEMPLATES))}")
    if template in TABLES:
        body = joined(rows, by, order, table_line(fields, technical, delimiter), "\r\n", "body")
        return body.select(*by, F.concat(F.lit(table_header(technical, delimiter) + "\r\n"), F.col("body"), F.lit("\r\n")).alias("content"))
    if template == MANIFEST:
        if artists is None:
            artists = F.filter(F.split(fields.get("artist", F.lit("")), r"\s*;\s*"), lambda x: x != "")
        return library_manifest(rows, by, order, F.struct(*[c.alias(k) for k, c in fields.items()]), fields.get("album", F.lit("")), artists, fields.get("size", F.lit(0)), exported)
    kind, text = TEMPLATES[template] if template else ("txt", text)
    counts = rows.groupBy(*by).agg(F.count("*").alias("_count"))
    own = numbered(rows.withColumns({f"_f_{k}": c for k, c in fields.items()}), by, order, "_n").join(counts, by)
    general = {"count": F.col("_count"), "exported": F.lit(exported), "delimiter": F.lit(delimiter)}
    head, block, tail = block_template(text)
    body = joined(own, by, [F.col("_n")], rendered(block, {k: F.col(f"_f_{k}") for k in fields} | general | {"index": F.col("_n")}, kind), "", "body").join(counts, by)
    return body.select(*by, F.concat(rendered(head, general, kind), F.col("body"), rendered(tail, general, kind)).alias("content"))
