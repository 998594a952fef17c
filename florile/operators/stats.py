"""Collections, totals, counters and common values. All sums and counts combine before their shuffle."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim


def collections(rows: DataFrame, values: Column, size: Column | None = None, seconds: Column | None = None, find: str = "") -> DataFrame:
    """Each distinct trimmed value of an array with its rows, bytes and seconds, most rows first. find filters the groups, not the rows."""
    v = rows.select(F.explode(values).alias("v"), (size if size is not None else F.lit(0)).alias("b"), (seconds if seconds is not None else F.lit(0.0)).alias("s"))
    v = v.select(trim(F.col("v")).alias("value"), "b", "s").where("value <> ''")
    out = v.groupBy("value").agg(F.count("*").alias("n_rows"), F.sum(F.coalesce("b", F.lit(0))).cast("long").alias("bytes"), F.sum(F.coalesce("s", F.lit(0.0))).alias("seconds"))
    if find:
        out = out.where(F.contains(F.lower("value"), F.lit(find.lower())))
    return out.orderBy(F.desc("n_rows"), F.asc("value"))


def totals(rows: DataFrame, size: Column, flags: dict[str, Column]) -> DataFrame:
    """One row: n_rows, bytes and a count for each flag."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()]
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), *counts)


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), F.asc(column)).limit(n)


def distinct_counts(rows: DataFrame, scalars: dict[str, Column], lists: dict[str, Column]) -> DataFrame:
    """One row with the count of distinct values of each column; lists are flattened. Each value is counted in its own group, so that
    no set of values is held whole."""
    pairs = [F.array(F.struct(F.lit(k).alias("k"), c.cast("string").alias("v"))) for k, c in scalars.items()]
    pairs += [_tagged(k, c) for k, c in lists.items()]
    flat = rows.select(F.explode(F.concat(*pairs)).alias("p")).select("p.*").where("v IS NOT NULL AND v <> ''").distinct()
    names = [*scalars, *lists]
    return flat.agg(*[F.count_if(F.col("k") == k).alias(k) for k in names])


def _tagged(name: str, values: Column) -> Column:
    none = F.array().cast("array<struct<k:string,v:string>>")
    return F.coalesce(F.transform(values, lambda x: F.struct(F.lit(name).alias("k"), x.alias("v"))), none)


def common_value(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """For each group: the most frequent value (of equals, the one seen first), and whether there are several."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    best = F.max_by(F.col(value), F.struct("n", -F.col("first")))
    return counts.groupBy(*by).agg(best.alias("common"), (F.count("*") > 1).alias("mixed"))


def with_dimension(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Every row of the dimension with the count of its rows, 0 too. Counted first, so that the join meets one row for each key."""
    counts = rows.groupBy(F.col(key).alias(dimension_key)).agg(F.count("*").alias("n_rows"))
    return dimension.join(counts, dimension_key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def issues(rows: DataFrame, id: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row for each issue: id, message and severity. rules: message to (severity, condition). The rule list is ours."""
    each = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(m).alias("message"), F.lit(s).alias("severity"))) for m, (s, c) in rules.items()]
    return rows.select(F.col(id), F.explode_outer(F.array_compact(F.array(*each))).alias("i")).where("i IS NOT NULL").select(id, "i.*")


def issue_histogram(found: DataFrame, n: int = 14) -> DataFrame:
    return top_values(found, "message", n)


def health(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """One row with the share of rows that meet each condition, in whole percent (100 for no rows). The formula is ours."""
    share = [F.coalesce(F.floor(100.0 * F.count_if(F.coalesce(c, F.lit(False))) / F.nullif(F.count("*"), F.lit(0)) + 0.5), F.lit(100)).cast("int").alias(k) for k, c in parts.items()]
    return rows.agg(*share)


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "index") -> DataFrame:
    """A rising number from 1 within each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
