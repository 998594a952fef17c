"""Joins of what is nearly equal, without comparing all with all: sets of words by a prefix filter, numbers by buckets.

similar_sets finds every pair of rows whose words have a Jaccard coefficient of a threshold or more. Words are put into one order for all rows,
rare ones first. Two sets that are similar enough share a word among the first few of both (how many follows from their sizes), so
rows meet on those alone; sizes and places in the order rule out more before sets are held against each other. Where all words are frequent, short sets
meet on several of them together: two sets that have to have so many in common share their first k common words, which stand further in front
the fewer k is; the sizes of both say how far. No pair is lost.

band_join finds every pair of rows whose numbers lie within a width of each other. Each left row has one bucket of that width, each right
row its own and both neighbours, so a pair meets once. What lies between rounded bounds, as in SQL, is found too.

A word or bucket that many rows have is dealt into parts: its left rows by a hash, its right rows to all of them.
"""

from functools import reduce
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_place

#: A key is dealt into parts of a HOT_SHARE-th of all left rows, and PART rows at least, so the keys to deal are HOT_SHARE at most.
HOT_SHARE, PART = 10_000, 4096
#: Pairs that single words may bring for each of their entries before several are put together; the choices of words that a set then has for each
#: size of a partner, the words in one, and the words of sets that this is done for, at most.
CROWD, MOST, TOGETHER, LONGEST = 32, 32, 8, 64


def dealt(left: DataFrame, right: DataFrame, on: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """left and right with a column part: rows of a key that many left rows have are dealt by a hash of by, those of right copied to each part."""
    most = max(PART, left.count() // HOT_SHARE)
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    hot, parts = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    own = left.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64(*by, F.lit(3)), parts).cast("int")).drop("_parts")
    return own, right.join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")


def _sets(rows: DataFrame, side: int, id: str, words: Column, block: list[str]) -> DataFrame:
    """side, id, word: the different words of each row, as numbers; those of rows in different blocks have nothing in common."""
    every = F.filter(words, lambda w: w.isNotNull())
    return rows.select(F.lit(side).alias("side"), F.col(id).alias("id"), F.explode(F.array_distinct(F.transform(every, lambda w: F.xxhash64(*[F.col(c) for c in block], w)))).alias("word"))


def _need(threshold: float) -> float:
    """The share of two sizes' sum that two sets have to have in common."""
    return threshold / (1 + threshold)


def _together(s: int, r: int, threshold: float) -> tuple[int, int]:
    """For sets of two sizes: the words they have to have in common, and how many of them are put together (1 where more would be too many)."""
    need = ceil(_need(threshold) * (s + r) - 1e-9)
    if need > min(s, r) or max(s, r) > LONGEST:
        return need, 1
    return need, max([k for k in range(2, min(need, TOGETHER) + 1) if comb(max(s, r) - need + k, k) <= MOST], default=1)


def _put_together(rows: DataFrame, side: int, sizes: list[int], others: list[int], threshold: float) -> DataFrame:
    """id, words, size, first, word of the rows of a side: for each size of a partner, each choice of so many words (first) among those where the first common ones stand."""
    table = []
    for s in sizes:
        for r in others:
            need, k = _together(s, r, threshold)
            if k > 1:
                table += [(s, r, list(at)) for at in combinations(range(s - need + k), k)]
    ways = F.broadcast(rows.sparkSession.createDataFrame(table, "size int, other int, at array<int>"))
    own = rows.where(F.col("side") == side).join(ways, "size").withColumn("first", F.transform("at", lambda i: F.get("words", i)))
    pair = ("size", "other") if side == 0 else ("other", "size")
    return own.select("id", "words", "size", "first", F.xxhash64(*pair, "first").alias("word"))


def _met(rows: DataFrame, alone: bool, threshold: float) -> DataFrame:
    """a, words_a, size_a, b, words_b, size_b, shared: rows that meet on their first common words, each pair once. alone: rows are those of one side."""
    first = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    entries = rows.select("side", "id", "words", "size", F.posexplode(F.slice("words", F.lit(1), first)).alias("at", "word"))
    left, right = (F.count_if(F.col("side") == k).cast("double") for k in (0, 0 if alone else 1))
    crowd = entries.groupBy("word").agg(left.alias("l"), right.alias("r")).agg(F.sum(F.col("l") * F.col("r")).alias("pairs"), F.sum(F.col("l") + F.col("r")).alias("n")).first()
    sizes = [sorted(r["size"] for r in rows.where(F.col("side") == k).select("size").distinct().collect()) for k in (0, 0 if alone else 1)]
    short = [[s for s in own if s <= LONGEST] for own in sizes]
    ways = [_together(s, r, threshold) for s in short[0] for r in short[1] if s >= threshold * r - 1e-9 and r >= threshold * s - 1e-9]
    crowded = (crowd["pairs"] or 0) > CROWD * (crowd["n"] or 0) and any(k > 1 for _, k in ways)
    own, found = F.col("a") < F.col("b") if alone else F.lit(True), []
    if crowded:
        one = _put_together(rows, 0, short[0], short[1], threshold).toDF("a", "words_a", "size_a", "first", "word")
        two = _put_together(rows.withColumn("side", F.lit(1)) if alone else rows, 1, short[1], short[0], threshold).drop("first").toDF("b", "words_b", "size_b", "word")
        one, two = dealt(one, two, ["word"], ["a"])
        met = one.join(two, ["word", "part"]).where(own).withColumn("shared", F.array_intersect("words_a", "words_b"))
        found.append(met.where(F.slice("shared", F.lit(1), F.size("first")) == F.col("first")))
    if not crowded or short != sizes or any(k == 1 for _, k in ways):
        one = entries.where("side = 0").drop("side")
        two = (one if alone else entries.where("side = 1").drop("side")).toDF("b", "words_b", "size_b", "at_b", "word")
        one, two = dealt(one.toDF("a", "words_a", "size_a", "at_a", "word"), two, ["word"], ["a"])
        # Of the two sizes, the smaller has to be threshold of the larger; what is left of both from here has to be enough.
        fits = (F.col("size_b") >= threshold * F.col("size_a") - 1e-9) & (F.col("size_a") >= threshold * F.col("size_b") - 1e-9)
        both = F.col("size_a") + F.col("size_b")
        fits &= F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= _need(threshold) * both - 1e-9
        if crowded:
            # As _together has it: those of which two words or more are put together have met.
            need, most = F.ceil(_need(threshold) * both - 1e-9), F.greatest("size_a", "size_b")
            fits &= (most > LONGEST) | (need < 2) | ((most - need + 2) * (most - need + 1) / 2 > MOST)
        met = one.join(two, ["word", "part"]).where(fits & own).withColumn("shared", F.array_intersect("words_a", "words_b"))
        found.append(met.where(F.get("shared", F.lit(0)) == F.col("word")))
    columns = ("a", "words_a", "size_a", "b", "words_b", "size_b", "shared")
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in found])


def similar_sets(left: DataFrame, right: DataFrame | None, id: str, words: Column, threshold: float, block: list[str] | None = None) -> DataFrame:
    """(a, b, common, score) for each pair of a row of left and a row of right (of two rows of left with a < b where right is None) whose words have a
    Jaccard coefficient of threshold (over 0) or more. id: a column without repeats or nulls; block: columns that pairs have to agree in.

    A row without words is in no pair. Rows with the same words make all their pairs; collapse them before where there are many. The sets are
    written to shared_place, as they are read several times.
    """
    both = _sets(left, 0, id, words, block or [])
    if right is not None:
        both = both.unionByName(_sets(right, 1, id, words, block or []))
    spark = left.sparkSession
    place = shared_place(spark, "sets")
    both.write.parquet(f"{place}/words")
    both = spark.read.parquet(f"{place}/words")
    often = both.groupBy("word").agg(F.count("*").alias("n"))
    rows = both.join(often, "word").groupBy("side", "id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w"))
    rows.select("side", "id", F.col("w.word").alias("words"), F.size("w").alias("size")).write.parquet(f"{place}/rows")
    met = _met(spark.read.parquet(f"{place}/rows"), right is None, threshold)
    score = F.size("shared") / (F.col("size_a") + F.col("size_b") - F.size("shared"))
    return met.select("a", "b", F.size("shared").alias("common"), score.alias("score")).where(F.col("score") >= threshold - 1e-12)


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: float, by: list[str], on: list[str] | None = None, between: bool = False) -> DataFrame:
    """Pairs of rows with |a - b| <= width and equal columns on: all columns of both, which have to have different names but for on. by: columns of left that tell its rows apart.

    Null and NaN values are in no pair; infinite ones neither, as their distances aren't numbers.
    between: pairs with a BETWEEN b - width AND b + width instead, as SQL has it. Of numbers at the very edge, a rounded bound lets in others than
    a rounded distance does (300.1 - 300 is over 0.1, and 300.1 - 0.1 is 300); NaN is equal to NaN, and infinite values to themselves.
    """
    if width < 0:
        raise ValueError("width is under 0")
    on = on or []
    # A little more than the width, so that rounding doesn't part a pair by two buckets.
    step = width * (1 + 1e-9) if width else 1.0
    if between:
        # Rounding keeps order, so what lies between the bounds has a bucket from that of one to that of the other.
        low, high = F.col(b).cast("double") - width, F.col(b).cast("double") + width
        place = lambda c: F.floor(c / step)
        one = left.where(F.col(a).isNotNull()).withColumn("_bucket", place(F.col(a).cast("double")))
        two = right.where(F.col(b).isNotNull()).withColumn("_bucket", F.explode(F.sequence(place(low), place(high))))
        one, two = dealt(one, two, [*on, "_bucket"], by)
        return one.join(two, [*on, "_bucket", "part"]).where(F.col(a).cast("double").between(low, high)).drop("_bucket", "part")
    good = lambda c: F.abs(F.col(c).cast("double")) < F.lit(float("inf"))
    bucket = lambda c: F.floor(F.col(c).cast("double") / step).cast("decimal(38,0)")
    one = left.where(good(a)).withColumn("_bucket", bucket(a))
    two = right.where(good(b)).withColumn("_bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: (bucket(b) + k).cast("decimal(38,0)"))))
    one, two = dealt(one, two, [*on, "_bucket"], by)
    return one.join(two, [*on, "_bucket", "part"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_bucket", "part")
