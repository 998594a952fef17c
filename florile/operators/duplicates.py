"""Duplicate groups by several signals, ranked, with the member to keep.

Each signal gives rows a key; rows of a key form a group. All signals are exploded into (kind, key) pairs and grouped once. Groups are
never gathered into a list: what identifies a group's member set is its size and two 64-bit sums of hashed ids, its keeper is a maximum,
and members stay rows.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of groups with the same members, the kind of the highest rank stays.
RANK = {"fingerprint": 3, "exact": 2, "metadata": 1}


def tag_signature(parts: list[Column], least: int = 3) -> Column:
    """Lower-cased, trimmed parts joined by a bar; null if fewer than least parts are there. Counted before they are joined."""
    own = [F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]
    there = sum((F.when(p != "", 1).otherwise(0) for p in own), F.lit(0))
    return F.when(there >= least, F.concat_ws("|", *own))


def loose_signature(artist: Column, album: Column, seconds: Column, step: float = 2.0) -> Column:
    """Artist, album and the length in whole steps: nearly the same recording, whatever its title. Null without an artist and without an album.

    Lengths on either side of a step's edge differ; nearby.band_join has no edges."""
    own = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (artist, album)]
    return F.when((own[0] != "") | (own[1] != ""), F.concat_ws("|", *own, F.coalesce(F.floor(seconds / step + 0.5).cast("string"), F.lit(""))))


def members(rows: DataFrame, id: str, signals: Mapping[str, Column], keep: list[Column], size: Column) -> DataFrame:
    """(kind, key, id, is_keeper, n, total_bytes, reclaimable): every row of every group of two or more that wasn't collapsed.

    keep: what makes a row the keeper, best first (compared as a struct, larger is better); then the smaller id.
    """
    pairs = F.array_compact(F.array(*[F.when(c.isNotNull() & (c != ""), F.struct(F.lit(k).alias("kind"), c.alias("key"))) for k, c in signals.items()]))
    best = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keep)], (-F.col(id)).alias("id"))
    flat = rows.select(F.col(id).alias("id"), size.alias("size"), best.alias("best"), F.explode(pairs).alias("p")).select("p.*", "id", "size", "best")
    code = F.xxhash64("id")
    groups = flat.groupBy("kind", "key").agg(
        F.count("*").alias("n"), F.bit_xor(code).alias("x"), F.bit_xor(F.xxhash64(code, F.lit(1))).alias("y"), F.max("best").alias("top"), F.sum("size").cast("long").alias("total_bytes"), F.max_by("size", "best").cast("long").alias("kept")
    ).where("n > 1")
    rank = F.coalesce(*[F.when(F.col("kind") == k, r) for k, r in RANK.items()], F.lit(0))
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("n", "x", "y").orderBy(rank.desc(), "key"))).where("place = 1")
    groups = groups.select("kind", "key", "n", "top", "total_bytes", (F.col("total_bytes") - F.col("kept")).alias("reclaimable"))
    return flat.join(groups, ["kind", "key"]).select("kind", "key", "id", (F.col("best") == F.col("top")).alias("is_keeper"), "n", "total_bytes", "reclaimable")


def groups(found: DataFrame) -> DataFrame:
    """One row for each group, most reclaimable first."""
    out = found.groupBy("kind", "key").agg(F.max("n").alias("n"), F.max("total_bytes").alias("total_bytes"), F.max("reclaimable").alias("reclaimable"), F.max(F.when(F.col("is_keeper"), F.col("id"))).alias("keeper"))
    return out.orderBy(F.desc("reclaimable"), "kind", "key")
