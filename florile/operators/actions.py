"""Action steps over records: each step makes a patch of fields from the record as it was; patches are merged, later ones on top.

Records have the columns artist, artists, album_artist, album_artists, date, year, name, track, compilation, comment (those that a step
reads or writes). A patched field takes its value even if that is empty; a field that no step patches stays.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, text
from . import cleanup
from .replace import replaced, strip_featured

#: Of a field: where the step applies, and the value there.
Patch = dict[str, tuple[Column, Column]]


def _first(many: str, one: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(many), F.lit(1)), F.col(one))


def copy_artist(source: str, target: str) -> Patch:
    """source and target are "artist" or "album_artist"."""
    v = _first(f"{source}s", source)
    some = v.isNotNull() & (v != "")
    return {f"{target}s": (some, F.array(v)), target: (some, v)}


def year_from_date() -> Patch:
    y = F.regexp_extract("date", r"^(\d{4})", 1)
    return {"year": (y != "", y.try_cast("int"))}


def date_from_year(style: str = "year") -> Patch:
    shape = {"full": "-01-01", "year-month": "-01"}.get(style, "")
    return {"date": (F.col("year").isNotNull() & (F.coalesce(F.col("date"), F.lit("")) == ""), F.concat(F.col("year").cast("string"), F.lit(shape)))}


def without_featured() -> Patch:
    own = F.coalesce(F.col("artists"), F.when(F.col("artist") != "", F.array("artist")), F.array().cast("array<string>"))
    new = F.filter(F.transform(own, lambda a: text.trim(strip_featured(a))), lambda a: a != "")
    some = (F.size(new) > 0) & (new != own)
    return {"artists": (some, new), "artist": (some, F.try_element_at(new, F.lit(1)))}


def split_artists() -> Patch:
    own = F.filter(F.transform(F.split("artist", "[;,]"), text.trim), lambda a: a != "")
    some = F.coalesce(F.size(own) > 1, F.lit(False))
    return {"artists": (some, own), "artist": (some, F.try_element_at(own, F.lit(1)))}


def track_from_name() -> Patch:
    n = F.regexp_extract("name", r"^(\d{1,2})[\s._-]", 1)
    return {"track": (n != "", n.try_cast("int"))}


def mark_compilation() -> Patch:
    return {"compilation": (F.lit(True), F.lit(True))}


def clear_comment() -> Patch:
    return {"comment": (F.lit(True), F.lit(""))}


def replace_text(fields: list[str], find: str, with_: str, lists: tuple[str, ...] = ("artists", "album_artists", "genres")) -> Patch:
    """Lists are rewritten value by value."""
    out: Patch = {}
    for f in fields:
        new = F.transform(F.col(f), lambda x: replaced(x, find, with_)) if f in lists else replaced(F.col(f), find, with_)
        out[f] = (F.coalesce(new != F.col(f), F.lit(False)), new)
    return out


def clean_text(fields: list[str]) -> Patch:
    """Trim, collapse spaces, compose characters and drop what has no width."""
    out: Patch = {}
    for f in fields:
        new = text.drop_invisible(arrow.nfc(text.collapse_spaces(text.trim(F.col(f)))))
        out[f] = (F.coalesce(new != F.col(f), F.lit(False)), new)
    return out


STEPS: dict[str, Callable[..., Patch]] = {
    "albumartist-from-artist": lambda: copy_artist("artist", "album_artist"),
    "artist-from-albumartist": lambda: copy_artist("album_artist", "artist"),
    "year-from-date": year_from_date,
    "date-from-year": date_from_year,
    "strip-featured": without_featured,
    "split-artists": split_artists,
    "track-number-from-filename": track_from_name,
    "compilation-flag": mark_compilation,
    "clear-comment": clear_comment,
    "replace-text": replace_text,
    "cleanup-text": clean_text,
}


def apply(records: DataFrame, patches: list[Patch]) -> DataFrame:
    """records with the merged patches, and changes."""
    merged: dict[str, Column] = {}
    for p in patches:
        for f, (where, value) in p.items():
            merged[f] = F.when(where, value).otherwise(merged.get(f, F.col(f)))
    before = records.withColumns({f"_before_{f}": F.col(f) for f in merged})
    return cleanup.with_changes(before.withColumns(merged), list(merged)).drop(*(f"_before_{f}" for f in merged))


def replace_in_scopes(records: DataFrame, scopes: list[str], find: str, with_: str, **options) -> DataFrame:
    """records with every scope (text, list or map column) rewritten; changes as (field, before, after) for each value, and hits."""
    from .replace import hits

    kinds = dict(records.dtypes)
    regex, fold = options.get("regex", False), options.get("ignore_case", True)
    new: dict[str, Column] = {}
    changes: list[Column] = []
    counts: list[Column] = []
    none = F.array().cast("array<struct<field:string,before:string,after:string>>")
    for f in scopes:
        c = F.col(f)
        kind = kinds[f]
        pairs = F.map_entries(c) if kind.startswith("map") else F.transform(c, lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value"))) if kind.startswith("array") else F.array(F.struct(F.lit(None).cast("string").alias("key"), c.alias("value")))
        made = F.transform(pairs, lambda p: F.struct(F.concat_ws(".", F.lit(f), p["key"]).alias("field"), p["value"].alias("before"), replaced(p["value"], find, with_, **options).alias("after")))
        changes.append(F.coalesce(F.filter(made, lambda m: m["before"] != m["after"]), none))
        counts.append(F.coalesce(F.aggregate(F.transform(made, lambda m: F.when(m["before"] != m["after"], hits(m["before"], find, regex, fold)).otherwise(0)), F.lit(0), lambda a, x: a + x), F.lit(0)))
        new[f] = F.transform_values(c, lambda k, v: replaced(v, find, with_, **options)) if kind.startswith("map") else F.transform(c, lambda v: replaced(v, find, with_, **options)) if kind.startswith("array") else replaced(c, find, with_, **options)
    total = sum(counts[1:], counts[0]) if counts else F.lit(0)
    return records.withColumns({"changes": F.concat(*changes) if changes else none, "hits": total}).withColumns(new)


def mapping_preview(raw: DataFrame, id: str, mapping: DataFrame) -> DataFrame:
    """Native keys to fields: values of one key joined by " & ", several keys of a field by " / " in the order of the mapping.

    raw: id and tags, an array of (key, values). mapping: key, field and rank, a small table.
    """
    flat = raw.select(id, F.explode("tags").alias("t")).select(id, F.col("t.key").alias("key"), F.array_join("t.values", " & ").alias("value"))
    met = flat.join(mapping, "key")
    return met.groupBy(id, "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "value"))), lambda x: x["value"]), " / ").alias("value"))


def write_issues(records: DataFrame, id: str, format: str, formats: DataFrame, images: str, lyrics: str, lists: list[str], texts: list[str]) -> DataFrame:
    """What a container would lose or refuse, as (id, field, severity). formats is the (small) dimension of containers."""
    r = records.join(F.broadcast(formats.withColumnRenamed("format", "_format").withColumnsRenamed({c: f"_{c}" for c in formats.columns if c != "format"})), F.col(format) == F.col("_format"))
    control = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
    issue = lambda when, field, severity: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity")))
    each = [
        issue(~F.col("_writable"), "format", "error"),
        issue((F.col(images) > 0) & ~F.col("_artwork"), "artwork", "error"),
        issue((F.col(lyrics) != "") & ~F.col("_lyrics"), "lyrics", "warning"),
        *[issue((F.size(c) > 1) & ~F.col("_multi_value"), c, "warning") for c in lists],
        *[issue(F.exists(c, lambda v: F.contains(v, F.lit("\x00"))) & F.col("_multi_value"), c, "error") for c in lists],
        issue(F.exists(F.array(*texts), lambda v: v.rlike(control)), "control-characters", "warning"),
    ]
    return r.select(F.col(id), F.explode(F.array_compact(F.array(*each))).alias("i")).select(id, "i.*")


def apply_release(records: DataFrame, releases: DataFrame) -> DataFrame:
    """Album fields of a record's release (release_id) over its own, and the title of the track at its position, where there is one."""
    r = releases.select(F.col("id").alias("_release"), F.col("title").alias("_album"), "artists", F.col("year").alias("_year"), F.explode_outer("tracks").alias("t")).select("_release", "_album", F.array_join("artists", " & ").alias("_artist"), "_year", F.col("t.position").alias("_position"), F.col("t.title").alias("_title"))
    albums = r.groupBy("_release").agg(F.any_value("_album").alias("_album"), F.any_value("_artist").alias("_artist"), F.any_value("_year").alias("_year"))
    tracks = r.where("_position IS NOT NULL").groupBy(F.col("_release").alias("_of"), "_position").agg(F.min("_title").alias("_title"))
    out = records.join(albums, F.col("release_id") == F.col("_release"), "left").join(tracks, (F.col("release_id") == F.col("_of")) & (F.col("track") == F.col("_position")), "left")
    return out.withColumns({"album": F.coalesce("_album", "album"), "album_artist": F.coalesce("_artist", "album_artist"), "year": F.coalesce("_year", "year"), "title": F.coalesce("_title", "title")}).select(*records.columns)
