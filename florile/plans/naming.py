"""Queries: names made from templates and taken apart, rename plans."""

from pyspark.sql import functions as F

from ..catalog import bind
from ..operators import templates
from . import tables


def name_generate(spark, sf_dir):
    c = tables.parts(spark, sf_dir)
    path, missing = templates.generate(c, "%album%/%track% - %genre% (%composer%)")
    return c.rows.select("p_partkey", path.alias("path"), F.array_join(missing, ",").alias("missing"))


def name_generate_raw(spark, sf_dir):
    c = tables.parts(spark, sf_dir)
    path, _ = templates.generate(c, r"100\% %artist%: %title%", sanitise=False, case="upper")
    return c.rows.select("p_partkey", path.alias("path"))


def name_title_case(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    return p.select("p_partkey", templates.in_case(F.col("p_name"), "title").alias("name"))


def name_parse(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    v = templates.parse(F.concat("c_name", F.lit(".mp3")), "%kind%#%num%")
    return c.select("c_custkey", v["kind"].alias("kind"), v["num"].try_cast("int").alias("num"), v["matched"].alias("matched"), F.round(v["coverage"], 6).alias("coverage"))


def name_sanitize(spark, sf_dir):
    p = tables.read(spark, sf_dir, "pages")
    return p.select("page_id", templates.sanitised(F.col("url")).alias("name"), templates.sanitised(F.regexp_replace("url", "[^:/]", "")).alias("none"))


def name_guess(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    return o.groupBy(templates.guess(F.concat("o_orderpriority", F.lit(" - "), "o_orderstatus", F.lit(".mp3"))).alias("template")).agg(F.count("*").alias("n"))


def rename_collisions(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part").withColumn("target", F.concat("p_name", F.lit(".mp3")))
    return templates.without_collisions(p, ["p_brand"], "target", "p_partkey").select("p_partkey", "new_name", "clash")


def rename_skip(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part").withColumn("target", F.upper("p_name"))
    return templates.without_collisions(p, ["p_brand"], "target", "p_partkey", "skip").select("p_partkey", "new_name")


def rename_numbered(spark, sf_dir):
    """Names that collide, some of which have a number already."""
    p = tables.read(spark, sf_dir, "part").withColumn("target", F.concat(F.substring_index("p_name", " ", 1), F.when(F.col("p_partkey") % 9 == 0, " (3)").otherwise(""), F.lit(".mp3")))
    return templates.without_collisions(p, ["p_brand"], "target", "p_partkey").select("p_partkey", "new_name", "clash")


def rename_cancel(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part").withColumn("target", F.upper("p_name"))
    return templates.without_collisions(p, ["p_brand"], "target", "p_partkey", "cancel").select("p_partkey", "new_name", "clash")


def name_parse_greedy(spark, sf_dir):
    """Names that a template fits as a whole, from its first to its last literal, or not at all."""
    c = tables.read(spark, sf_dir, "customer")
    raw = F.element_at(F.array(F.concat(F.col("c_mktsegment"), F.lit("["), F.col("c_custkey"), F.lit("]x.mp3")), F.concat(F.lit("["), F.col("c_custkey"), F.lit("].mp3")), F.lit("none.mp3")), (F.col("c_custkey") % 3 + 1).cast("int"))
    v = templates.parse_greedy(raw, "%kind%[%num%]%rest%")
    return c.select("c_custkey", v["kind"].alias("kind"), v["num"].alias("num"), v["rest"].alias("rest"), v["matched"].alias("matched"), F.round(v["coverage"], 6).alias("coverage"))


def name_presets(spark, sf_dir):
    """The first ready pattern that fits, and the guessed one, for names of every form."""
    c = tables.read(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    names = F.array(F.concat(k, F.lit(" - a - b")), F.concat(F.lit("art - t"), k), F.concat(k, F.lit(". song")), F.concat(k, F.lit(" song")), F.concat(F.lit("song"), k))
    raw = F.concat(F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")), F.lit(".mp3"))
    return c.select("c_custkey", templates.parse_first(raw).alias("preset"), templates.guess(raw).alias("guess"))


def missing_tokens(spark, sf_dir):
    """Tokens without a value anywhere in a group of rows."""
    rows = tables.labelled(spark, sf_dir)
    c = bind(rows.rows, "doc_id", text={"title": "text"}, number={"track": "quality", "disc": "toxic"})
    _, missing = templates.generate(c, "%track% %disc% %title% %composer%")
    flat = rows.rows.select("lang", F.explode(missing).alias("token")).distinct()
    return flat.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("tokens"))


QUERIES = {f.__name__: f for f in (name_generate, name_generate_raw, name_title_case, name_parse, name_sanitize, name_guess, rename_collisions, rename_numbered, rename_skip, rename_cancel, name_parse_greedy, name_presets, missing_tokens)}

_CLEAN = r"""regexp_replace(trim(regexp_replace(regexp_replace({}, '[\x00-\x1f<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g')), '[. ]+$', '')"""


def _clean(x: str) -> str:
    c = _CLEAN.replace("{}", x)
    return f"CASE WHEN {c} = '' THEN 'Unknown' ELSE {c} END"


ORACLE = {
    "name_generate": "SELECT p_partkey, " + _clean("p_brand") + " || '/' || " + _clean("lpad(p_size::VARCHAR, greatest(2, length(p_size::VARCHAR))::INT, '0') || ' - ' || replace(p_name, ' ', ' / ') || ' ()'") + " AS path, 'composer' AS missing FROM part",
    "name_generate_raw": "SELECT p_partkey, '100% ' || upper(p_brand || ' & ' || p_type) || ': ' || upper(p_name) AS path FROM part",
    "name_title_case": "SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' ') AS name FROM part",
    "name_parse": "SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2)::INT AS num, true AS matched, round((length(c_name) - 1) / length(c_name), 6) AS coverage FROM customer",
    "name_sanitize": "SELECT page_id, " + _clean("url") + " AS name, 'Unknown' AS none FROM pages",
    "name_guess": "SELECT '%track% %title%' AS template, count(*) AS n FROM orders",
    "rename_collisions": "SELECT p_partkey, CASE WHEN r = 1 THEN p_name || '.mp3' ELSE p_name || ' (' || r || ').mp3' END AS new_name, r > 1 AS clash FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS r FROM part)",
    "rename_skip": "SELECT p_partkey, CASE WHEN r = 1 THEN upper(p_name) END AS new_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS r FROM part)",
    "missing_tokens": "SELECT lang, concat_ws(',', 'composer', CASE WHEN bool_or(toxic IS NULL) THEN 'disc' END, CASE WHEN bool_or(coalesce(text, '') = '') THEN 'title' END, CASE WHEN bool_or(quality IS NULL) THEN 'track' END) AS tokens FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
}
ORACLE["rename_cancel"] = "SELECT p_partkey, upper(p_name) AS new_name, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) > 1 AS clash FROM part"
ORACLE["rename_numbered"] = """
WITH t AS (SELECT *, split_part(p_name, ' ', 1) AS w, p_partkey % 9 = 0 AS has FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(w), has ORDER BY p_partkey) AS r, bool_or(has) OVER (PARTITION BY p_brand, lower(w)) AS used FROM t)
SELECT p_partkey, w || CASE WHEN has THEN ' (3)' ELSE '' END || CASE WHEN r = 1 THEN '' ELSE ' (' || (r + CASE WHEN NOT has AND used AND r >= 3 THEN 1 ELSE 0 END) || ')' END || '.mp3' AS new_name, r > 1 AS clash FROM r"""
ORACLE["name_parse_greedy"] = """
SELECT c_custkey, CASE WHEN k = 0 THEN c_mktsegment END AS kind, CASE WHEN k < 2 THEN c_custkey::VARCHAR END AS num, CASE WHEN k = 0 THEN 'x' END AS rest, k < 2 AS matched,
  CASE k WHEN 0 THEN round((length(c_mktsegment) + length(c_custkey::VARCHAR) + 1) / (length(c_mktsegment) + length(c_custkey::VARCHAR) + 3), 6) WHEN 1 THEN 1.0 ELSE 0.0 END AS coverage
FROM (SELECT *, c_custkey % 3 AS k FROM customer)"""
ORACLE["name_presets"] = """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '%track% - %artist% - %title%' WHEN 1 THEN '%artist% - %title%' WHEN 2 THEN '%track%. %title%' END AS preset,
  CASE c_custkey % 5 WHEN 0 THEN '%track% - %artist% - %title%' WHEN 1 THEN '%artist% - %title%' WHEN 2 THEN '%track% %title%' WHEN 3 THEN '%track% %title%' ELSE '%title%' END AS guess FROM customer"""
