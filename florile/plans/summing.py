"""Queries: collections, totals, counters, duplicates."""

from pyspark.sql import functions as F

from ..operators import duplicates, stats
from . import tables


def collection_word(spark, sf_dir):
    out = stats.collections(tables.read(spark, sf_dir, "part"), F.split("p_name", " "), F.col("p_size"), F.col("p_retailprice"))
    return out.withColumn("seconds", F.round("seconds", 2))


def collection_filtered(spark, sf_dir):
    return stats.collections(tables.read(spark, sf_dir, "part"), F.split("p_name", " "), F.col("p_size"), find="a").select("value", "n_rows", "bytes")


def totals_by_flag(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    return stats.totals(o, F.col("o_custkey"), {"n_open": F.col("o_orderstatus") == "O", "n_urgent": F.col("o_orderpriority") == "1-URGENT"})


def top5_bucket(spark, sf_dir):
    return stats.top_values(tables.read(spark, sf_dir, "orders"), "o_orderpriority", 5)


def distinct_counters(spark, sf_dir):
    return stats.distinct_counts(tables.read(spark, sf_dir, "part"), {"brands": F.col("p_brand"), "types": F.col("p_type"), "sizes": F.col("p_size")}, {"words": F.split("p_name", " ")})


def dimension_outer(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer").where("c_acctbal < -900")
    return stats.with_dimension(c, "c_nationkey", tables.read(spark, sf_dir, "nation"), "n_nationkey").select("n_nationkey", "n_name", "n_rows")


def mode_mixed(spark, sf_dir):
    return stats.common_value(tables.read(spark, sf_dir, "part"), ["p_type"], "p_brand", "p_partkey")


def issue_histogram(spark, sf_dir):
    d = tables.labelled(spark, sf_dir).rows
    found = stats.issues(d, "doc_id", {"no label": ("info", F.col("quality").isNull()), "toxic": ("error", F.col("toxic") == 1), "short": ("warning", F.col("n_chars") < 500), "junk": ("warning", F.col("quality") == 0)})
    return stats.issue_histogram(found)


def health_scores(spark, sf_dir):
    d = tables.labelled(spark, sf_dir).rows
    return stats.health(d, {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "clean": F.coalesce(F.col("toxic"), F.lit(0)) == 0})


def summary_line(spark, sf_dir):
    """Counts for each language, most first, as one line."""
    n = tables.read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    lines = n.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "lang"))).alias("x"))
    return lines.select(F.array_join(F.transform("x", lambda x: F.concat((-x["n"]).cast("string"), F.lit(" "), x["lang"])), ", ").alias("line"))


def _signals(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    head = F.regexp_extract("text", r"^(\S+ \S+ \S+)", 1)
    return d, {"exact": F.sha2("text", 256), "metadata": duplicates.tag_signature([F.col("lang"), F.col("source"), head, F.col("n_chars")])}


def dup_members(spark, sf_dir):
    d, signals = _signals(spark, sf_dir)
    found = duplicates.members(d, "doc_id", signals, [F.col("n_chars")], F.col("n_chars"))
    return found.select("kind", "id", "is_keeper", "n")


def dup_groups(spark, sf_dir):
    d, signals = _signals(spark, sf_dir)
    found = duplicates.members(d, "doc_id", signals, [F.col("n_chars")], F.col("n_chars"))
    return duplicates.groups(found).select("kind", "key", "n", "total_bytes", "reclaimable", "keeper")


def dup_reclaimable(spark, sf_dir):
    d, signals = _signals(spark, sf_dir)
    found = duplicates.members(d, "doc_id", {"exact": signals["exact"]}, [F.col("n_chars")], F.col("n_chars"))
    return duplicates.groups(found).agg(F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"), F.count("*").alias("n_groups"))


def album_groups(spark, sf_dir):
    """Grouping by artist and album, without case and outer space; rows without album are left out."""
    p = tables.read(spark, sf_dir, "part")
    key = F.concat_ws("|", F.lower(F.trim("p_brand")), F.lower(F.trim("p_name")))
    return p.where("trim(p_name) <> ''").groupBy(key.alias("album_key")).agg(F.count("*").alias("n_rows"), F.min("p_partkey").alias("first"))


QUERIES = {f.__name__: f for f in (collection_word, collection_filtered, totals_by_flag, top5_bucket, distinct_counters, dimension_outer, mode_mixed, issue_histogram, health_scores, summary_line, dup_members, dup_groups, dup_reclaimable, album_groups)}

_WORDS = "SELECT trim(w) AS value, p_size, p_retailprice FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_size, p_retailprice FROM part) WHERE trim(w) <> ''"
_DUPS = """
WITH pairs AS (
  SELECT 'exact' AS kind, sha256(text) AS key, doc_id, n_chars FROM documents
  UNION ALL
  SELECT 'metadata', lower(trim(lang)) || '|' || lower(trim(source)) || '|' || lower(trim(h)) || '|' || n_chars, doc_id, n_chars
  FROM (SELECT *, regexp_extract(text, '^([^\\t\\n\\x0B\\f\\r ]+ [^\\t\\n\\x0B\\f\\r ]+ [^\\t\\n\\x0B\\f\\r ]+)', 1) AS h FROM documents)
  WHERE (lang <> '')::INT + (source <> '')::INT + (trim(h) <> '')::INT + 1 >= 3
), g AS (
  SELECT kind, key, count(*) AS n, sum(n_chars)::BIGINT AS total_bytes, list(doc_id ORDER BY doc_id) AS ids, arg_min(doc_id, (-n_chars, doc_id)) AS keeper, max(n_chars) AS kept
  FROM pairs GROUP BY kind, key HAVING count(*) > 1
), best AS (SELECT *, row_number() OVER (PARTITION BY ids ORDER BY kind = 'exact' DESC, key) AS r FROM g)
"""
ORACLE = {
    "collection_word": f"SELECT value, count(*) AS n_rows, sum(p_size)::BIGINT AS bytes, round(sum(p_retailprice), 2) AS seconds FROM ({_WORDS}) GROUP BY value",
    "collection_filtered": f"SELECT value, count(*) AS n_rows, sum(p_size)::BIGINT AS bytes FROM ({_WORDS}) GROUP BY value HAVING contains(lower(value), 'a')",
    "totals_by_flag": "SELECT count(*) AS n_rows, sum(o_custkey)::BIGINT AS bytes, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent FROM orders",
    "top5_bucket": "SELECT o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "distinct_counters": "SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '') AS words FROM part",
    "dimension_outer": "SELECT n_nationkey, n_name, count(c_custkey) AS n_rows FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < -900 GROUP BY 1, 2",
    "mode_mixed": "SELECT p_type, arg_max(p_brand, (n, -f)) AS common, count(*) > 1 AS mixed FROM (SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2) GROUP BY 1",
    "issue_histogram": """SELECT message, count(*) AS n_rows FROM (
SELECT unnest(list_filter([CASE WHEN quality IS NULL THEN 'no label' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN quality = 0 THEN 'junk' END], lambda x: x IS NOT NULL)) AS message
FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 14""",
    "health_scores": "SELECT floor(100.0 * count(quality) / count(*) + 0.5)::INT AS labelled, floor(100.0 * count(*) FILTER (WHERE quality = 1) / count(*) + 0.5)::INT AS good, floor(100.0 * count(*) FILTER (WHERE coalesce(toxic, 0) = 0) / count(*) + 0.5)::INT AS clean FROM documents LEFT JOIN labels USING (doc_id)",
    "summary_line": "SELECT string_agg(n || ' ' || lang, ', ' ORDER BY n DESC, lang) AS line FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)",
    "dup_members": _DUPS + "SELECT kind, unnest(ids) AS id, unnest(ids) = keeper AS is_keeper, n FROM best WHERE r = 1",
    "dup_groups": _DUPS + "SELECT kind, key, n, total_bytes, (total_bytes - kept)::BIGINT AS reclaimable, keeper FROM best WHERE r = 1",
    "dup_reclaimable": "SELECT coalesce(sum(r), 0)::BIGINT AS reclaimable, count(*) AS n_groups FROM (SELECT sum(n_chars) - max(n_chars) AS r FROM documents GROUP BY text HAVING count(*) > 1)",
    "album_groups": "SELECT lower(trim(p_brand)) || '|' || lower(trim(p_name)) AS album_key, count(*) AS n_rows, min(p_partkey) AS first FROM part WHERE trim(p_name) <> '' GROUP BY 1",
}
