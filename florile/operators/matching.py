"""Fuzzy matching of rows against releases: weighted signals, blockers and a verdict.

Scoring every row against every release doesn't scale, so candidates come from blocking keys: a pair is scored if it shares one.
Which keys (barcode, catalogue number, a word of the artist) is the caller's choice; recall follows from them.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import catalog_form, half_up, similar_form, similarity

#: Scores of years that are equal, one apart, further apart, and not on both sides.
YEARS = (1.0, 0.6, 0.1, 0.5)
#: Weights of the signals, cut-offs of the verdicts and the confidence from which a match is taken over.
WEIGHT = {"artist": 3.0, "album": 2.5, "title": 2.5, "track": 2.0, "duration": 1.5, "trackCount": 1.0, "discCount": 1.0, "year": 1.5, "barcode": 6.0, "catalog": 4.0}
VERDICTS = ((92, "certain"), (80, "likely"), (60, "possible"))
IMPORT_FROM = 80


@dataclass(frozen=True)
class Signal:
    """score is 0 to 1; the signal counts where present holds."""

    name: str
    score: Column
    present: Column | None = None


def near_number(a: Column, b: Column, tolerance: float) -> Column:
    """1 within the tolerance, a half within four times it (of 1 at least), else 0; a half if either is absent."""
    gap = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), 0.5).when(gap <= tolerance, 1.0).when(gap <= 4 * max(tolerance, 1), 0.5).otherwise(0.0)


def year_score(a: Column, b: Column) -> Column:
    same, next_, far, unknown = YEARS
    return F.when(a.isNull() | b.isNull(), unknown).when(a == b, same).when(F.abs(a - b) <= 1, next_).otherwise(far)


def count_score(own: Column, other: Column) -> Column:
    return F.when(own.isNull(), 0.5).when(own == other, 1.0).otherwise(0.2)


def disc_score(own: Column, other: Column) -> Column:
    """For releases of several discs; a count that is absent is 1."""
    return F.when(F.coalesce(own, F.lit(1)) == other, 1.0).otherwise(0.3)


def barcode_score(own: Column, other: Column) -> Column:
    """Barcodes have to be identical."""
    return F.when((own != "") & (own == other), 1.0).otherwise(0.0)


def code_score(own: Column, other: Column) -> Column:
    """Codes compared without case and signs."""
    return F.when(catalog_form(F.coalesce(own, F.lit(""))) == catalog_form(other), 1.0).otherwise(0.0)


def blockers(own: Column, other: Column, identical: bool = False) -> Column:
    """Barcodes that are both there and differ speak against the match. identical: as they stand, else without case and signs."""
    form = (lambda c: c) if identical else catalog_form
    differs = (own != "") & (other != "") & (form(own) != form(other))
    return F.when(differs, F.array(F.lit("barcode"))).otherwise(F.array().cast("array<string>"))


def release_signals(file: dict[str, Column], release: dict[str, Column], normal: bool = False) -> list[Signal]:
    """The ten signals of a file and a release, from columns artist, album, title, track, seconds, n_tracks, n_discs, year, barcode and catalog of either.

    normal: artist, album and title are in similar_form already, made once for each row rather than for each pair.
    """
    f, r = file, release
    text_ = lambda k: similarity(F.coalesce(f[k], F.lit("")), F.coalesce(r[k], F.lit("")), normal)
    some = lambda c: c.isNotNull() & (c.cast("string") != "")
    return [
        Signal("artist", text_("artist")),
        Signal("album", text_("album")),
        Signal("title", text_("title")),
        Signal("track", near_number(f["track"], r["track"], 0)),
        Signal("duration", near_number(f["seconds"], r["seconds"], 3)),
        Signal("trackCount", count_score(f["n_tracks"], r["n_tracks"]), r["n_tracks"].isNotNull()),
        Signal("discCount", disc_score(f["n_discs"], r["n_discs"]), F.coalesce(r["n_discs"] > 1, F.lit(False))),
        Signal("year", year_score(f["year"], r["year"]), F.coalesce(r["year"] != 0, F.lit(False))),
        Signal("barcode", barcode_score(f["barcode"], r["barcode"]), some(r["barcode"])),
        Signal("catalog", F.when(some(f["catalog"]), code_score(f["catalog"], r["catalog"])).otherwise(0.0), some(r["catalog"])),
    ]


def with_scores(pairs: DataFrame, signals: list[Signal]) -> tuple[DataFrame, list[Signal]]:
    """pairs with a column for each score, and the signals that read them, so that what follows works none out twice."""
    return pairs.withColumns({f"score_{s.name}": s.score for s in signals}), [Signal(s.name, F.col(f"score_{s.name}"), s.present) for s in signals]


def confidence(signals: list[Signal]) -> Column:
    """The weighted mean of the signals that are present, in whole percent, halves up."""
    weight = [F.when(s.present, WEIGHT[s.name]).otherwise(0.0) if s.present is not None else F.lit(WEIGHT[s.name]) for s in signals]
    total = sum(weight[1:], weight[0])
    score = [s.score * w for s, w in zip(signals, weight)]
    return half_up(100 * sum(score[1:], score[0]) / F.when(total == 0, 1.0).otherwise(total)).cast("int")


def explained(signals: list[Signal]) -> Column:
    """The present signals by falling share in the score, as an array of (signal, score, weight)."""
    each = [F.struct((-s.score * WEIGHT[s.name]).alias("share"), F.lit(i).alias("i"), F.lit(s.name).alias("signal"), s.score.alias("score"), F.lit(WEIGHT[s.name]).alias("weight")) for i, s in enumerate(signals)]
    here = [F.when(s.present, x) if s.present is not None else x for s, x in zip(signals, each)]
    return F.transform(F.array_sort(F.array_compact(F.array(*here))), lambda x: F.struct(x["signal"].alias("signal"), x["score"].alias("score"), x["weight"].alias("weight")))


def verdict(c: Column, blocked: Column | None = None) -> Column:
    """By the confidence alone or, if blocked is given, never certain where that holds."""
    capped = c if blocked is None else F.when(blocked, F.least(c, F.lit(VERDICTS[0][0] - 1))).otherwise(c)
    out = F.lit("unlikely")
    for least, name in reversed(VERDICTS):
        out = F.when(capped >= least, name).otherwise(out)
    return out


def candidates(left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """Distinct (left_id, right_id) that share a blocking key. keys: name to (array of the left row, array of the right row)."""

    def exploded(df: DataFrame, id: str, side: int) -> DataFrame:
        none = F.array().cast("array<struct<k:string,v:string>>")
        tagged = [F.coalesce(_tag(name, pair[side]), none) for name, pair in keys.items()]
        return df.select(F.col(id), F.explode(F.array_distinct(F.concat(*tagged))).alias("b")).where("b.v <> ''")

    return exploded(left, left_id, 0).join(exploded(right, right_id, 1), "b").select(left_id, right_id).distinct()


def _tag(name: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(name).alias("k"), x.alias("v")))


def release_track(tracks: Column, number: Column, title: Column, least: float = 0.85) -> Column:
    """The first track at the position, else the first whose title is more similar than least. Select it as one column and take its fields from that, so that it is found once."""
    wanted = similar_form(title)
    by_number = F.filter(tracks, lambda t: t["position"] == number)
    formed = F.transform(tracks, lambda t: F.struct(t.alias("t"), similar_form(t["title"]).alias("form")))
    by_title = F.transform(F.filter(formed, lambda x: similarity(x["form"], wanted, normal=True) > least), lambda x: x["t"])
    return F.get(F.when(F.size(by_number) > 0, by_number).otherwise(by_title), F.lit(0))


def album_match(scored: DataFrame, by: list[str]) -> DataFrame:
    """For each group: the mean confidence, halves up, the best one, and the blockers that any member has."""
    return scored.groupBy(*by).agg(half_up(F.avg("confidence")).cast("int").alias("confidence"), F.max("confidence").alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("blockers")))).alias("blockers"))
