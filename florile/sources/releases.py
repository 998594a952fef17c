"""Releases from JSON documents of catalog services, as they were stored by whoever fetched them (nothing here uses a network)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_year, seconds
from .records import checked

#: Schema of a stored release: what the two shapes that services use have in common, and what sets them apart.
SCHEMA = """id string, title string, date string, year string, barcode string, country string, status string,
 `artist-credit` array<struct<name:string,joinphrase:string>>, artists array<struct<name:string,`join`:string>>,
 `label-info` array<struct<`catalog-number`:string,label:struct<name:string>>>, labels array<struct<name:string,catno:string>>,
 media array<struct<position:int,format:string,tracks:array<struct<position:int,title:string,length:double>>>>,
 tracklist array<struct<position:string,title:string,duration:string>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    return releases(spark.read.schema(SCHEMA).json(path))


def credit(names: Column) -> Column:
    """Names with the phrases between them."""
    return F.array_join(F.transform(names, lambda n: F.concat(n["name"], F.coalesce(n["joinphrase"], F.lit("")))), "")


def releases(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """id, title, artists, year, barcode, catalog_number, label, disc_count, track_count and tracks (position, title, seconds), after the columns to keep.

    Lengths of the first shape are milliseconds, those of the second m:ss texts; both become seconds.
    """
    discs = F.coalesce(F.size("media"), F.lit(1))
    from_media = F.flatten(F.transform("media", lambda m: F.transform(m["tracks"], lambda t: F.struct(t["position"].alias("position"), t["title"].alias("title"), (t["length"] / 1000).alias("seconds")))))
    from_list = F.transform("tracklist", lambda t, i: F.struct((i + 1).alias("position"), t["title"].alias("title"), seconds(t["duration"]).alias("seconds")))
    tracks = F.coalesce(from_media, from_list, F.array().cast("array<struct<position:int,title:string,seconds:double>>"))
    names = F.coalesce(F.transform("artist-credit", lambda a: a["name"]), F.transform("artists", lambda a: F.regexp_replace(a["name"], r" \(\d+\)$", "")), F.array().cast("array<string>"))
    info, label = F.get(F.col("label-info"), F.lit(0)), F.get(F.col("labels"), F.lit(0))
    out = raw.select(*(keep or []), "id", "title", names.alias("artists"), F.coalesce(first_year(F.col("date")), first_year(F.col("year"))).alias("year"), "barcode", F.coalesce(info["catalog-number"], label["catno"]).alias("catalog_number"), F.coalesce(info["label"]["name"], label["name"]).alias("label"), discs.alias("disc_count"), tracks.alias("tracks"))
    return out.withColumn("track_count", F.size("tracks"))


def union(frames: list[DataFrame]) -> DataFrame:
    """All services' releases; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def placeholders(candidates: Column) -> Column:
    """Artwork that isn't read yet, for an array of candidates (id, url, type, width, height): front covers of no bytes, with what is known of their size."""
    size = lambda c: F.coalesce(c, F.lit(0))
    return F.transform(candidates, lambda a: F.struct(a["id"].alias("id"), a["url"].alias("url"), F.lit("front").alias("role"), a["type"].alias("description"), F.lit("image/jpeg").alias("mime"), size(a["width"]).alias("width"), size(a["height"]).alias("height"), F.lit(0).alias("bytes")))


def search_text(fields: dict[str, Column]) -> Column:
    """A query for a service's search: the strongest identifier alone, else what is there joined by AND. Signs are escaped."""
    clean = {k: F.regexp_replace(c, r'([+\-!(){}\[\]^"~*?:\\/]|&&|\|\|)', r"\\$1") for k, c in fields.items()}
    some = {k: F.when(clean[k] != "", F.concat(F.lit(f'{k}:"'), clean[k], F.lit('"'))) for k in clean}
    strong = [some[k] for k in ("barcode", "catno", "id") if k in some]
    rest = [some[k] for k in some if k not in ("barcode", "catno", "id")]
    return F.coalesce(*strong, F.concat_ws(" AND ", *rest) if rest else F.lit(""))


def fan_out(answers: dict[str, DataFrame], column: str = "value") -> DataFrame:
    """All services' answers, a JSON text each, as rows: service, text, record (id and title) and errors. A service that gives broken answers takes nothing from the others."""
    own = [checked(a.select(F.lit(name).alias("service"), F.col(column).alias("text")), "text", {"id": "string", "title": "string"}) for name, a in answers.items()]
    return union(own)


def hits(answers: DataFrame) -> DataFrame:
    """Releases, with their service, of the answers of fan_out that have no errors."""
    good = answers.where(F.size("errors") == 0)
    raw = good.select("service", F.from_json("text", SCHEMA).alias("r")).select("service", "r.*")
    return releases(raw, ["service"])
