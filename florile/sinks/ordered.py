"""Lists without bound: text files in parts, ordered within each list, that no task and no cell holds whole.

All lines of all lists are sorted once, by list and order, into ranges; a long list goes on over many ranges, a range may hold many short
lists. Each list is a folder, list=NAME, and its files in the order of their names are its text. Heads and tails are rows before and
after a list's own, made of totals that are added up in part before they are shuffled.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import playlists

#: The list of rows whose list is null or empty.
NAMELESS = "__nameless__"


def write_lists(rows: DataFrame, by: str, order: list[Column], line: Column, path: str, head: Column | None = None, tail: Column | None = None, totals: list[Column] | None = None, separator: str = "", mode: str = "errorifexists") -> None:
    """Write a list for each value of by. order, from small to large, has to tell a list's rows apart, or ties come in any order.

    line may have several lines; rows whose line is null have none. head and tail are made of by and totals (aggregates with names), and
    separator ends every line of a list but its last. At most 100 000 parts, or names are out of order.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    name = F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit(NAMELESS))
    # The list's name is never null or empty: Spark then takes the sort below for the one that it needs, and adds none that is not stable.
    body = rows.select(name.alias("list"), F.lit(1).alias("_part"), *[o.alias(k) for o, k in zip(order, keys)], line.alias("value"))
    if separator:
        body = body.where("value IS NOT NULL")
        last = body.groupBy("list").agg(F.max(F.struct(*keys)).alias("_last"))
        ends = F.struct(*keys).eqNullSafe(F.col("_last"))
        body = body.join(last, "list").withColumn("value", F.concat("value", F.when(ends, "").otherwise(separator))).drop("_last")
    sums = rows.groupBy(name.alias("list")).agg(F.first(by).alias(by) if by != "list" else F.count("*").alias("_n"), *(totals or []))
    for part, text in ((0, head), (2, tail)):
        if text is not None:
            body = body.unionByName(sums.select("list", F.lit(part).alias("_part"), text.alias("value")), allowMissingColumns=True)
    body.where("value IS NOT NULL").orderBy("list", "_part", *keys).select("list", "value").write.mode(mode).partitionBy("list").text(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """list, number (from 1) and value of the lines that write_lists wrote. Lines are numbered within a file's blocks, and blocks by their counts."""
    block = ["list", "_file", "_start"]
    lines = spark.read.schema("value string, list string").text(path).select("list", "value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("list").orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    begins = lines.groupBy(*block).agg(F.count("*").alias("_n")).withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = lines.withColumn("_at", F.row_number().over(Window.partitionBy(*block).orderBy("_id")))
    return own.join(begins, block).select("list", (F.col("_begin") + F.col("_at")).alias("number"), "value")


def numbered(rows: DataFrame, by: str, order: list[Column], place: str, name: str = "number") -> DataFrame:
    """rows with a number from 1 within each value of by, however many rows that has. They are sorted into ranges and written to place, and a
    row's number is its place in its file, after the rows of its group in earlier files. order has to tell a group's rows apart."""
    keys = {f"_k{i}": o for i, o in enumerate(order)}
    rows.withColumns(keys).orderBy(by, *keys).drop(*keys).write.mode("overwrite").parquet(place)
    back = rows.sparkSession.read.schema(rows.schema).parquet(place).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.partitionBy("_g").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    begins = back.groupBy(F.col(by).alias("_g"), F.col("_file").alias("_f")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first")).withColumnRenamed("_f", "_file")
    begins = begins.select("_g", F.col("_file").alias("_f"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_begin"))
    met = back.join(begins, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_file") == F.col("_f")))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_begin") + F.col("_row")).alias(name))


def write_m3u(rows: DataFrame, by: str, order: list[Column], t: playlists.Track, path: str, absolute: bool = True, base: str = "", extended: bool = True, mode: str = "errorifexists") -> None:
    """The lists of playlists.m3u_list, of any length."""
    head, line = playlists.m3u_parts(t, absolute, base, extended)
    write_lists(rows, by, order, line, path, head if extended else None, None, [playlists.first_row(t, order)] if extended else None, mode=mode)


def write_pls(rows: DataFrame, by: str, order: list[Column], t: playlists.Track, path: str, place: str, absolute: bool = True, base: str = "", mode: str = "errorifexists") -> None:
    """The lists of playlists.pls_list, of any length. place: a folder for the sorted rows, which the caller may delete."""
    own = rows.select(F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit(NAMELESS)).alias("_list"), *[c.alias(k) for k, c in playlists.pls_columns(t, absolute, base).items()], *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    own = numbered(own, "_list", [F.col(f"_o{i}") for i in range(len(order))], place, "_n")
    tail = F.concat(F.lit("NumberOfEntries="), F.col("_count").cast("string"), F.lit("\nVersion=2"))
    write_lists(own, "_list", [F.col("_n")], playlists.pls_lines(F.col("_n"), F.col("_title"), F.col("_seconds"), F.col("_path")), path, F.lit("[playlist]"), tail, [F.count("*").alias("_count")], mode=mode)


def write_xspf(rows: DataFrame, by: str, order: list[Column], t: playlists.Track, path: str, absolute: bool = True, base: str = "", mode: str = "errorifexists") -> None:
    """The lists of playlists.xspf_document, of any length."""
    head, line, tail = playlists.xspf_parts(t, absolute, base)
    write_lists(rows, by, order, line, path, head, F.lit(tail), [playlists.first_row(t, order)], mode=mode)


def write_json(rows: DataFrame, by: str, order: list[Column], track: Column, path: str, mode: str = "errorifexists") -> None:
    """Manifests with the number of files and their tracks, one to a line."""
    write_lists(rows, by, order, F.to_json(track), path, F.concat(F.lit('{"files":'), F.col("_count").cast("string"), F.lit(',"tracks":[')), F.lit("]}"), [F.count("*").alias("_count")], ",", mode)
