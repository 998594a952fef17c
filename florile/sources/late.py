"""Bytes that are read late: rows are chosen by their slim columns, and only then are the wide ones of the chosen rows read.

A first scan reads what the choice needs, a second one the id and the wide columns. The second is bounded by the smallest and the largest
chosen id, as a filter that the scan has before it starts, so that files and row groups beyond them are left out where the table is
ordered by id. Nothing of it comes to the driver, and a small choice is broadcast by its measured size alone.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import number
from ..functions.text import once
from . import chunks


def first_of(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group. Partitions keep n of a group before they are shuffled, so a large group is no large task."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def fetched(chosen: DataFrame, rows: DataFrame, id: str, wide: list[str]) -> DataFrame:
    """chosen with the wide columns that rows has for its ids. chosen must not be made of wide columns; ids of rows are unique, null ids find nothing."""
    ends = [chosen.agg(f(id)).scalar() for f in (F.min, F.max)]
    return chosen.join(rows.select(id, *wide).where(F.col(id).between(*ends)), id)


def picture(content: Column, own: Column) -> Column:
    """What a FLAC picture block says, without the picture: kind, mime, width, height, and where its bytes start and how many there are."""

    def of(x: Column) -> Column:
        c, at = x["c"], x["at"]
        mime = number(c, at + 4, 4)
        text = number(c, at + 8 + mime, 4)
        rest = at + 12 + mime + text
        length = number(c, rest + 16, 4)
        there = F.struct(number(c, at, 4).cast("int").alias("kind"), F.decode(F.substring(c, at + 9, mime.cast("int")), "US-ASCII").alias("mime"), number(c, rest, 4).alias("width"), number(c, rest + 4, 4).alias("height"), (rest + 20).cast("int").alias("start"), length.cast("int").alias("length"))
        return F.when(rest + 20 + length <= at + x["size"], there)

    return once(F.struct(content.alias("c"), own["start"].cast("long").alias("at"), own["length"].alias("size")), of)


def flac_pictures(content: Column) -> Column:
    """Pictures of a FLAC file by their blocks, in order; those whose lengths don't fit their block are left out."""
    blocks = F.filter(chunks.walk(content, F.when(chunks.starts(content, b"fLaC"), F.lit(4)), F.octet_length(content), chunks.flac), lambda x: x["id"] == "6")
    return F.filter(F.transform(blocks, lambda b: picture(content, b)), lambda p: p.isNotNull())


def picture_bytes(content: Column, own: Column) -> Column:
    return F.substring(content, own["start"] + 1, own["length"])
