"""Queries: search language, views, smart rules, order."""

from pyspark.sql import functions as F

from ..operators import order, rules, search
from ..operators.rules import Rule
from . import tables

NOW = 1_000_000_000_000


def search_basic(spark, sf_dir):
    c = tables.documents(spark, sf_dir)
    return search.search(c, 'format:=en size:>=1000 -comment:"the"', sort=[("size", "desc")], limit=50).select("doc_id", "lang", "n_chars")


def search_text_terms(spark, sf_dir):
    return search.search(tables.documents(spark, sf_dir), "the \"of and\" src1").select("doc_id", "source")


def search_negated_field(spark, sf_dir):
    return search.search(tables.documents(spark, sf_dir), "-format:en -folder:=src0").select("doc_id", "lang", "source")


def search_negated_word(spark, sf_dir):
    return search.search(tables.documents(spark, sf_dir), "-the format:en").select("doc_id")


def search_numeric_ops(spark, sf_dir):
    return search.search(tables.parts(spark, sf_dir), "size:>=10 size:<20 bitrate:>910").select("p_partkey", "p_size")


def search_numeric_contains(spark, sf_dir):
    return search.search(tables.parts(spark, sf_dir), "size:4").select("p_partkey", "p_size")


def search_custom(spark, sf_dir):
    """Keys of a map of custom fields."""
    from ..catalog import bind

    p = tables.read(spark, sf_dir, "part").withColumn("own", F.create_map(F.lit("Mood"), F.col("p_type"), F.lit("brand"), F.col("p_brand")))
    return search.search(bind(p, "p_partkey", text={"title": "p_name"}, custom="own"), "custom.Mood:eco -custom.brand:=Brand#11 -custom.none:x").select("p_partkey")


def search_flags(spark, sf_dir):
    return search.search(tables.labelled(spark, sf_dir), "lossless:true modifiedflag:no").select("doc_id")


def search_multi_any(spark, sf_dir):
    """Not equal on a list: some value differs, or there is none."""
    c = tables.parts(spark, sf_dir)
    return search.search(c, "artist:!=Brand#11 genre:~e").select("p_partkey")


def smart_multi_none(spark, sf_dir):
    """Not equal in a smart rule: no value is equal."""
    return rules.smart_playlist(tables.parts(spark, sf_dir), [Rule("artist", "!=", "Brand#11")]).select("p_partkey")


RULES = [Rule("size", ">", "100000"), Rule("label", "=", "1-URGENT")]


def smart_all(spark, sf_dir):
    return rules.smart_playlist(tables.orders(spark, sf_dir), RULES, "all").select("o_orderkey")


def smart_any(spark, sf_dir):
    return rules.smart_playlist(tables.orders(spark, sf_dir), RULES, "any").select("o_orderkey")


def smart_none(spark, sf_dir):
    """A rule list that is empty takes no rows."""
    return rules.smart_playlist(tables.orders(spark, sf_dir), []).select("o_orderkey")


def view_flags(spark, sf_dir):
    c = tables.labelled(spark, sf_dir)
    own = rules.views(c, NOW)
    return c.rows.select("doc_id", own["lossless"].alias("lossless"), own["lossy"].alias("lossy"), own["dirty"].alias("dirty"), own["years"].alias("years"), own["folders"].alias("folders"))


def view_recent(spark, sf_dir):
    """The week before a given moment, over the events' own times."""
    from ..catalog import bind

    e = tables.read(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    c = bind(e, "event_id", number={"added": "ms"})
    return rules.view(c, "recent", 1706572800000).rows.select("event_id")


def view_all(spark, sf_dir):
    """Every named view over parts that have some of the fields, as flags."""
    from ..catalog import bind

    p = tables.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    some = lambda n, c: F.when(k % n > 0, c)
    c = bind(
        p, "p_partkey", text={"title": some(2, F.col("p_name")), "album": some(3, F.col("p_brand")), "label": some(5, F.col("p_type")), "publisher": some(7, F.col("p_type")), "folder": some(11, F.lit("f")), "error": some(13, F.lit(""))},
        multi={"artist": some(3, F.array("p_brand")), "genre": F.filter(F.split("p_name", " "), lambda w: w == "red")}, number={"added": k * 1000, "modified": k * 3000, "year": some(4, F.col("p_size"))}, flag={"writable": k % 2 == 0, "hasartwork": k % 3 == 0, "modifiedflag": some(5, k % 5 == 1), "lossless": k % 4 == 0},
    )
    own = rules.views(c, rules.WEEK_MS + 1_500_000)
    return c.rows.select("p_partkey", *[v.alias(n.replace("-", "_")) for n, v in own.items()])


def select_range(spark, sf_dir):
    """The parts between two of them, by brand falling and name."""
    return order.between(tables.parts(spark, sf_dir), [("album", "desc"), ("title", "asc")], 100, 30).select("p_partkey", "p_brand", "p_name")


def sort_collated(spark, sf_dir):
    """Regions and nations in the order people use: case and accents count last."""
    n = tables.read(spark, sf_dir, "nation")
    word = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    from ..catalog import bind

    c = bind(n.withColumn("word", word), "n_nationkey", text={"title": "word"})
    first = order.ordered(c, [("title", "asc")], "UNICODE").limit(10)
    return first.select("n_nationkey", "word")


def sort_null_rules_topk(spark, sf_dir):
    c = tables.labelled(spark, sf_dir)
    return order.top(c, [("track", "desc"), ("year", "asc"), ("size", "desc")], 40).select("doc_id", "quality", "toxic")


def sort_slice(spark, sf_dir):
    return order.slice_rows(tables.parts(spark, sf_dir), [("album", "desc"), ("title", "asc")], 100, 25).select("p_partkey", "p_brand")


def select_semi(spark, sf_dir):
    """The customers that a set of ids, from big orders, selects."""
    ids = tables.read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    from ..catalog import bind

    return order.selected(bind(tables.read(spark, sf_dir, "customer"), "c_custkey"), ids).select("c_custkey", "c_name")


def select_toggle(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    from ..catalog import bind

    c = bind(o, "o_orderkey")
    return order.toggled(c, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")))


QUERIES = {f.__name__: f for f in (search_basic, search_text_terms, search_negated_field, search_negated_word, search_numeric_ops, search_numeric_contains, search_custom, search_flags, search_multi_any, smart_multi_none, smart_all, smart_any, smart_none, view_flags, view_recent, view_all, select_range, sort_collated, sort_null_rules_topk, sort_slice, select_semi, select_toggle)}

ORACLE = {
    "search_basic": "SELECT doc_id, lang, n_chars FROM documents WHERE lower(lang) = 'en' AND n_chars >= 1000 AND lower(coalesce(text, '')) <> 'the' ORDER BY n_chars DESC, doc_id LIMIT 50",
    "search_text_terms": "SELECT doc_id, source FROM (SELECT *, lower(text || ' ' || lang || ' ' || source) AS h FROM documents) WHERE contains(h, 'the') AND contains(h, 'of and') AND contains(h, 'src1')",
    "search_negated_field": "SELECT doc_id, lang, source FROM documents WHERE lower(lang) <> 'en' AND lower(source) <> 'src0'",
    "search_negated_word": "SELECT doc_id FROM documents WHERE NOT contains(lower(text || ' ' || lang || ' ' || source), 'the') AND contains(lower(lang), 'en')",
    "search_numeric_ops": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 910",
    "search_numeric_contains": "SELECT p_partkey, p_size FROM part WHERE contains(p_size::VARCHAR, '4')",
    "search_flags": "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, false) AND NOT coalesce(toxic = 1, false)",
    "search_multi_any": "SELECT p_partkey FROM part WHERE (lower(p_brand) <> 'brand#11' OR lower(p_type) <> 'brand#11') AND len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'e'))) > 0",
    "smart_multi_none": "SELECT p_partkey FROM part WHERE lower(p_brand) <> 'brand#11' AND lower(p_type) <> 'brand#11'",
    "smart_all": "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'",
    "smart_any": "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 OR o_orderpriority = '1-URGENT'",
    "smart_none": "SELECT o_orderkey FROM orders WHERE false",
    "view_flags": "SELECT doc_id, coalesce(quality = 1, false) AS lossless, NOT coalesce(quality = 1, false) AS lossy, coalesce(toxic = 1, false) AS dirty, toxic IS NOT NULL AS years, coalesce(source, '') <> '' AS folders FROM documents LEFT JOIN labels USING (doc_id)",
    "view_recent": "SELECT event_id FROM events WHERE 1706572800000 - epoch_ms(ts) < 604800000",
    "sort_null_rules_topk": "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(quality::DOUBLE, 1e308) DESC, coalesce(toxic, 0), n_chars DESC, doc_id LIMIT 40",
    "sort_slice": "SELECT p_partkey, p_brand FROM part ORDER BY p_brand DESC, p_name, p_partkey LIMIT 25 OFFSET 100",
    "select_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "select_toggle": "WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT') (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)",
}
ORACLE["view_all"] = """
SELECT p_partkey, true AS all, 604800000 + 1500000 - k * 1000 < 604800000 AS recent, 604800000 + 1500000 - k * 3000 < 604800000 AS modified, k % 2 = 0 AS favorites, k % 2 = 0 AS writable, k % 3 <> 0 AS missing_artwork, k % 2 = 0 OR k % 3 = 0 AS missing_metadata,
  false AS errors, k % 5 = 1 AS dirty, k % 4 = 0 AS lossless, k % 4 <> 0 AS lossy, k % 3 > 0 AS artists, k % 3 > 0 AS albums, list_contains(string_split(p_name, ' '), 'red') AS genres, k % 4 > 0 AS years, k % 5 > 0 OR k % 7 > 0 AS labels, k % 11 > 0 AS folders
FROM (SELECT *, p_partkey AS k FROM part)"""
ORACLE["select_range"] = """
WITH r AS (SELECT *, row_number() OVER (ORDER BY p_brand DESC, p_name, p_partkey) AS i FROM part)
SELECT p_partkey, p_brand, p_name FROM r WHERE i BETWEEN (SELECT min(i) FROM r WHERE p_partkey IN (30, 100)) AND (SELECT max(i) FROM r WHERE p_partkey IN (30, 100))"""
ORACLE["sort_collated"] = "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS word FROM nation ORDER BY lower(n_name), n_nationkey LIMIT 10"
ORACLE["search_custom"] = "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'eco') AND lower(p_brand) <> 'brand#11'"
