"""Queries: similarity, weighted matching, releases."""

from pyspark.sql import functions as F

from ..functions.text import similar_form, similarity
from ..operators import matching, nearby
from ..operators.matching import Signal
from ..session import shared_place
from . import tables


def similarity_pairs(spark, sf_dir):
    """Parts of a brand, type and size whose names are similar. A name's comparison form is made once for each part, and two forms are scored once, however many parts and blocks have them."""
    block, place = ["p_brand", "p_type", "p_size"], shared_place(spark, "parts")
    p = tables.read(spark, sf_dir, "part").select("p_partkey", *block, similar_form(F.col("p_name")).alias("form"))
    p.where("form <> ''").write.parquet(place)
    p = spark.read.parquet(place)
    names = p.groupBy(*block, "form").agg(F.count("*").alias("n"))
    met = names.withColumnRenamed("form", "x").join(names.select(*block, F.col("form").alias("y")), block).where("x < y OR x = y AND n > 1").drop("n")
    s = similarity(F.col("x"), F.col("y"), normal=True)
    # The number keeps the optimizer from scoring before the pairs of forms are told apart.
    forms = met.select("x", "y").distinct().withColumn("i", F.monotonically_increasing_id())
    scores = forms.select("x", "y", "i", F.round(s, 6).alias("score")).where("score >= 0.4 AND i >= 0").drop("i")
    near = met.join(scores, ["x", "y"])
    side = lambda key, form: p.select(F.col("p_partkey").alias(key), *block, F.col("form").alias(form))
    both = near.join(side("k", "x"), [*block, "x"]).join(side("m", "y"), [*block, "y"]).where(F.when(F.col("x") == F.col("y"), F.col("k") < F.col("m")).otherwise(F.col("k") != F.col("m")))
    return both.select(F.least("k", "m").alias("a"), F.greatest("k", "m").alias("b"), "score")


def similar_names(spark, sf_dir):
    """Pairs of different names in comparison form within a brand, of any type and size, with a score of 0.4 or more, and the parts that have them.

    One row for each pair of names (a, b), or name alone (b is null) that several parts have, and part: name a or b has it. A score is at most 0.3
    without the words' coefficient and 0.7 of that, so pairs come from a join of sets of words with a seventh or more in common.
    """
    p = tables.read(spark, sf_dir, "part").select("p_partkey", "p_brand", similar_form(F.col("p_name")).alias("form"))
    names = p.where("form <> ''").groupBy("p_brand", "form").agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))
    met = nearby.similar_sets(names, None, "id", F.split("form", " "), (0.4 - 0.3) / 0.7, ["p_brand"])
    side = lambda id, name: names.select(F.col("id").alias(id), F.col("form").alias(name), *(["p_brand"] if name == "x" else []))
    met = met.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b")
    s = F.round(similarity(F.col("x"), F.col("y"), normal=True), 6)
    pairs = met.select("p_brand", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), s.alias("score")).where("score >= 0.4")
    same = names.where("n > 1").select("p_brand", F.col("form").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(1.0).alias("score"))
    sides = pairs.withColumn("form", F.explode(F.array("a", "b"))).unionByName(same.withColumn("form", F.col("a")))
    return sides.join(p, ["p_brand", "form"]).select("p_brand", "a", "b", "score", "form", "p_partkey")


def _titles(spark, sf_dir):
    """Different titles of parts: their words, the smallest key, and how many parts have them."""
    p = tables.read(spark, sf_dir, "part").withColumn("words", F.array_sort(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", (F.col("p_size") % 10).cast("string"))), " "))))
    return p.groupBy("words").agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))


def set_join(spark, sf_dir):
    """Titles whose sets of words have 0.6 or more in common, each pair of different ones once, with no key to block on."""
    t = _titles(spark, sf_dir)
    return nearby.similar_sets(t, None, "id", F.col("words"), 0.6).select("a", "b", "common", F.round("score", 9).alias("score"))


def release_join(spark, sf_dir):
    """For each title of odd keys (files) the titles of even keys (releases) with half of the words or more in common: how many, and the best."""
    t = _titles(spark, sf_dir)
    met = nearby.similar_sets(t.where("id % 2 = 1"), t.where("id % 2 = 0"), "id", F.col("words"), 0.5)
    best = F.min_by("b", F.struct((-F.col("score")).alias("s"), "b"))
    return met.groupBy("a").agg(F.count("*").alias("n_found"), best.alias("best"), F.round(F.max("score"), 9).alias("score"))


def tolerance_pairs(spark, sf_dir):
    """Customers and suppliers of one nation whose balances lie within 300 of each other, and nations one apart within 40 (a tolerance beside a tolerance)."""
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    s = tables.read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"))
    same = nearby.band_join(c, s, "c_acctbal", "s_acctbal", 300, ["c_custkey"], ["nation"], between=True).select("c_custkey", "s_suppkey", F.lit("same").alias("how"))
    near = nearby.band_join(c, s.withColumnRenamed("nation", "other"), "c_acctbal", "s_acctbal", 40, ["c_custkey"], between=True).where("abs(nation - other) = 1")
    return same.unionByName(near.select("c_custkey", "s_suppkey", F.lit("near").alias("how")))


def similarity_form(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(similar_form(F.col("text")), 256).alias("form"))


def benchmark_best(spark, sf_dir):
    """Sentences blocked by a benchmark item's first four words, scored as a whole."""
    head = lambda c: F.array_join(F.slice(F.split(F.lower(c), r"\s+"), 1, 4), " ")
    b = tables.read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\n|\. ")).alias("line"))
    both = d.withColumn("block", head(F.col("line"))).join(b.withColumn("block", head(F.col("item"))), "block")
    s = similarity(F.col("line"), F.col("item"))
    return both.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.max(s), 6).alias("best"))


SHINGLE = 5
#: Items up to which they are broadcast to the documents; beyond, they are joined by a shuffle.
BROADCAST_ITEMS = 50_000


def benchmark_passages(spark, sf_dir):
    """For each document and item that share a run of 5 words: the best score of a passage of the item's count of words against the whole item.

    Words are those of the comparison form of whole texts (of all of it, for items of fewer than 5 words). Each shared run says where the
    item would begin; the passage there is scored as a whole, so a passage inside a sentence is found wherever it stands.
    """
    words = lambda c: F.split(similar_form(c), " ")

    def runs(df, id, k=SHINGLE):
        size = F.size("w")
        at = F.posexplode(F.transform(F.sequence(F.lit(0), size - k), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, k), " "))))
        return df.where(size >= k).select(id, at.alias("i", "run"))

    b = tables.read(spark, sf_dir, "benchmark").select("item_id", similar_form(F.col("text")).alias("item")).where("item <> ''").withColumn("w", F.split("item", " "))
    d = tables.read(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    found = None
    small = lambda df: F.broadcast(df) if n_items <= BROADCAST_ITEMS else df
    n_items, lengths = b.count(), {r[0] for r in b.select(F.least(F.size("w"), F.lit(SHINGLE)).alias("k")).distinct().collect()}
    for k in sorted(lengths):  # an item of fewer words is one run of all of them
        own = runs(b if k == SHINGLE else b.where(F.size("w") == k), "item_id", k).withColumnRenamed("i", "j")
        hits = runs(d, "doc_id", k).join(small(own), "run").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("start")).distinct()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = d.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start")).limit(0)
    both = found.join(small(b.select("item_id", "item", F.size("w").alias("n"))), "item_id").join(d, "doc_id")
    low = F.greatest("start", F.lit(0))
    passage = F.array_join(F.slice("w", low + 1, F.col("start") + F.col("n") - low), " ")
    scored = both.select("doc_id", "item_id", F.contains(passage, F.col("item")).alias("whole"), F.round(similarity(passage, F.col("item"), normal=True), 6).alias("score"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("best"), F.max("whole").alias("whole"))


def _scored(spark, sf_dir):
    """Orders matched to customers: the customer's key and segment stand for codes, its balance for a number."""
    o = tables.read(spark, sf_dir, "orders")
    c = tables.read(spark, sf_dir, "customer")
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    year, other = F.year("o_orderdate"), F.lit(1995) + F.col("c_nationkey") % 4
    barcode, own = F.concat(F.lit("B-"), F.col("o_custkey") % 7), F.concat(F.lit("b "), F.col("c_custkey") % 7 + F.col("c_nationkey") % 2)
    signals = [
        Signal("year", matching.year_score(year, other)),
        Signal("duration", matching.near_number(F.col("o_totalprice") % 100, F.col("c_acctbal") % 100, 3), F.col("c_acctbal") > 0),
        Signal("trackCount", matching.count_score(F.length("o_orderpriority"), F.length("c_mktsegment"))),
        Signal("barcode", matching.code_score(barcode, own), own != ""),
    ]
    conf = matching.confidence(signals)
    block = matching.blockers(barcode, own)
    return both.select("o_orderkey", "c_custkey", "c_nationkey", conf.alias("confidence"), block.alias("blockers"), matching.explained(signals).alias("why"))


def match_confidence(spark, sf_dir):
    s = _scored(spark, sf_dir)
    blocked = F.size("blockers") > 0
    return s.select("o_orderkey", "confidence", blocked.alias("blocked"), matching.verdict(F.col("confidence"), blocked).alias("verdict"), F.col("why")[0]["signal"].alias("strongest"))


def album_rollup(spark, sf_dir):
    out = matching.album_match(_scored(spark, sf_dir), ["c_nationkey"])
    return out.select("c_nationkey", "confidence", "best", F.array_join("blockers", ",").alias("blockers"))


def match_candidates(spark, sf_dir):
    """Pairs of customer and supplier that share a blocking key: nation and a hash of the balance."""
    c, s = tables.read(spark, sf_dir, "customer"), tables.read(spark, sf_dir, "supplier")
    key = lambda n, b: F.array(F.concat(n.cast("string"), F.lit("/"), (F.abs(b) / 100).cast("int").cast("string")))
    keys = {"balance": (key(F.col("c_nationkey"), F.col("c_acctbal")), key(F.col("s_nationkey"), F.col("s_acctbal")))}
    return matching.candidates(c, s, keys, "c_custkey", "s_suppkey")


def release_track_lookup(spark, sf_dir):
    """Each order as a release whose tracks are its lines; the track at a position, else the one with the most similar title."""
    lines = tables.read(spark, sf_dir, "lineitem")
    track = F.struct(F.col("l_linenumber").cast("int").alias("position"), F.concat(F.lit("Line item "), F.col("l_linenumber").cast("string"), F.lit(" of it")).alias("title"), F.col("l_quantity").alias("seconds"))
    releases = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(track)).alias("tracks"))
    found = matching.release_track(F.col("tracks"), F.lit(3), F.lit("line item 1 of it"))
    return releases.select("l_orderkey", found.alias("track")).select("l_orderkey", "track.position", "track.seconds")


def match_release(spark, sf_dir):
    """Parts as files against the releases of their brand and type (the part of the smallest key, with a few values of its own), by blocking keys and all ten signals."""
    p = tables.read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    own = p.select(
        key.alias("file_id"), F.concat("p_brand", F.lit(" the band")).alias("artist"), F.col("p_type").alias("album"), F.col("p_name").alias("title"), (F.col("p_size") % 10).alias("track"), (F.col("p_retailprice") % 50).alias("seconds"),
        F.nullif(F.col("p_size") % 5, F.lit(0)).alias("n_tracks"), F.nullif(F.col("p_size") % 3, F.lit(0)).alias("n_discs"), (F.col("p_size") % 4 + 1990).alias("year"), F.nullif((key % 5).cast("string"), F.lit("0")).alias("barcode"), F.concat(F.lit("cat-"), key % 3).alias("catalog"), F.concat_ws("/", "p_brand", "p_type").alias("block"),
    )
    first = p.groupBy("p_brand", "p_type").agg(F.min(F.struct("p_partkey", "p_name", "p_size", "p_retailprice")).alias("x")).select("p_brand", "p_type", "x.*")
    other = first.select(
        key.alias("release_id"), F.concat(F.lit("The "), F.col("p_brand")).alias("artist"), F.col("p_type").alias("album"), F.col("p_name").alias("title"), (F.col("p_size") % 10).alias("track"), (F.col("p_retailprice") % 50).alias("seconds"),
        F.nullif(F.col("p_size") % 5, F.lit(0)).alias("n_tracks"), (F.col("p_size") % 3 + 1).alias("n_discs"), (F.col("p_size") % 4 + 1990).alias("year"), F.nullif((key % 5).cast("string"), F.lit("0")).alias("barcode"), F.concat(F.lit("CAT "), key % 3).alias("catalog"), F.concat_ws("/", "p_brand", "p_type").alias("block"),
    )
    pairs = matching.candidates(own, other, {"line": (F.array("block"), F.array("block"))}, "file_id", "release_id")
    forms = lambda df: df.withColumns({c: similar_form(F.col(c)) for c in ("artist", "album", "title")})
    both = pairs.join(forms(own).alias("f"), "file_id").join(forms(other).alias("r"), "release_id")
    side = lambda s: {c: F.col(f"{s}.{c}") for c in own.columns[1:-1]}
    both, signals = matching.with_scores(both, matching.release_signals(side("f"), side("r"), normal=True))
    blocked = F.size(matching.blockers(F.col("f.barcode"), F.col("r.barcode"), identical=True)) > 0
    out = both.select("file_id", "release_id", matching.confidence(signals).alias("confidence"), blocked.alias("blocked"), matching.explained(signals).alias("why"))
    return out.select("file_id", "release_id", "confidence", F.coalesce("blocked", F.lit(False)).alias("blocked"), matching.verdict(F.col("confidence")).alias("verdict"), F.size("why").alias("n_signals"), F.array_join("why.signal", ",").alias("signals"))


QUERIES = {f.__name__: f for f in (set_join, release_join, tolerance_pairs, similarity_pairs, similar_names, similarity_form, benchmark_best, benchmark_passages, match_confidence, match_release, album_rollup, match_candidates, release_track_lookup)}


def _sim(x: str = "x", y: str = "y", j: str = "j") -> str:
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0 WHEN {x} = {y} THEN 1 ELSE greatest(0.7 * {j} + 0.3 * (1 - levenshtein({x}, {y}) / greatest(length({x}), length({y}))), {j}) END"


def _jaccard(x: str = "x", y: str = "y") -> str:
    return f"(len(list_intersect(string_split({x}, ' '), string_split({y}, ' '))) / len(list_distinct(list_concat(string_split({x}, ' '), string_split({y}, ' ')))))"


_SIM, _J = _sim(), _jaccard()


def _form(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '\b(?:the|a|an|and|of|in|on)\b', ' ', 'g'), '[^a-z0-9\x{{0400}}-\x{{04FF}}\x{{4E00}}-\x{{9FFF}}]+', ' ', 'g'))"


_HEAD = r"array_to_string(list_slice(string_split_regex(lower({}), '[ \t\n\x0B\f\r]+'), 1, 4), ' ')"
_SCORED = """
WITH b AS (
  SELECT o_orderkey, c_nationkey,
    abs(year(o_orderdate) - (1995 + c_nationkey % 4)) AS dy, o_totalprice % 100 AS p, c_acctbal % 100 AS q, c_acctbal > 0 AS has, length(o_orderpriority) = length(c_mktsegment) AS same,
    'B' || o_custkey % 7 = 'B' || (c_custkey % 7 + c_nationkey % 2) AS code
  FROM orders JOIN customer ON o_custkey = c_custkey
), w AS (
  SELECT *, CASE WHEN dy = 0 THEN 1.0 WHEN dy <= 1 THEN 0.6 ELSE 0.1 END * 1.5 AS sy,
    CASE WHEN NOT has THEN 0.0 WHEN abs(p - q) <= 3 THEN 1.0 WHEN abs(p - q) <= 12 THEN 0.5 ELSE 0.0 END * 1.5 AS sd,
    CASE WHEN same THEN 1.0 ELSE 0.2 END AS st, CASE WHEN code THEN 6.0 ELSE 0.0 END AS sb
  FROM b
), s AS (SELECT *, floor(100 * (sy + sd + st + sb)::DOUBLE / (1.5 + CASE WHEN has THEN 1.5 ELSE 0 END + 1.0 + 6.0)::DOUBLE + 0.5)::INT AS confidence, NOT code AS blocked FROM w)
"""
ORACLE = {
    "similarity_pairs": f"WITH p AS (SELECT *, {_form('p_name')} AS f FROM part), q AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.f AS x, b.f AS y FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey), r AS (SELECT *, {_J} AS j FROM q) SELECT * FROM (SELECT a, b, round(({_SIM})::DOUBLE, 6) AS score FROM r) WHERE score >= 0.4",
    "similarity_form": f"SELECT doc_id, sha256({_form('text')}) AS form FROM documents",
    "benchmark_best": rf"WITH d AS (SELECT unnest(string_split_regex(text, '\n|\. ')) AS line FROM documents), m AS (SELECT item_id, {_form('line')} AS x, {_form('b.text')} AS y FROM d JOIN benchmark b ON {_HEAD.format('line')} = {_HEAD.format('b.text')}), r AS (SELECT *, {_J} AS j FROM m) SELECT item_id, count(*) AS n, round(max(({_SIM})::DOUBLE), 6) AS best FROM r GROUP BY 1",
    "match_confidence": _SCORED + """SELECT o_orderkey, confidence, blocked, CASE WHEN c >= 92 THEN 'certain' WHEN c >= 80 THEN 'likely' WHEN c >= 60 THEN 'possible' ELSE 'unlikely' END AS verdict,
 CASE WHEN sb > 0 THEN 'barcode' WHEN sy >= greatest(sd, st) THEN 'year' WHEN sd >= st AND has THEN 'duration' ELSE 'trackCount' END AS strongest FROM (SELECT *, CASE WHEN blocked THEN least(confidence, 91) ELSE confidence END AS c FROM s)""",
    "album_rollup": _SCORED + "SELECT c_nationkey, floor(avg(confidence) + 0.5)::INT AS confidence, max(confidence) AS best, CASE WHEN bool_or(blocked) THEN 'barcode' ELSE '' END AS blockers FROM s GROUP BY 1",
    "match_candidates": "SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND trunc(abs(c_acctbal) / 100) = trunc(abs(s_acctbal) / 100)",
    "release_track_lookup": "SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_linenumber = 3) > 0 THEN 3 WHEN count(*) FILTER (WHERE l_linenumber = 1) > 0 THEN 1 END AS position, coalesce(min(l_quantity) FILTER (WHERE l_linenumber = 3), min(l_quantity) FILTER (WHERE l_linenumber = 1)) AS seconds FROM lineitem GROUP BY 1",
}

_SIDE = """p_brand, p_type, p_name, p_size % 10 AS track, p_retailprice % 50 AS seconds, nullif(p_size % 5, 0) AS n_tracks, p_size % 4 AS year, nullif(p_partkey % 5, 0) AS barcode, p_partkey % 3 AS catalog, p_partkey AS id"""
_RELEASED = " UNION ALL ".join(
    f"SELECT file_id, release_id, {i} AS i, '{name}' AS signal, {weight}::DOUBLE AS w, ({score})::DOUBLE AS s FROM b WHERE {where}"
    for i, (name, weight, score, where) in enumerate(
        [
            ("artist", 3, _sim("ax", "ay", "aj"), "true"), ("album", 2.5, "1", "true"), ("title", 2.5, _SIM, "true"),
            *((n, w, f"CASE WHEN f_{c} IS NULL OR r_{c} IS NULL THEN 0.5 WHEN abs(f_{c} - r_{c}) <= {lo} THEN 1 WHEN abs(f_{c} - r_{c}) <= {hi} THEN 0.5 ELSE 0 END", "true") for n, w, c, (lo, hi) in (("track", 2, "track", (0, 4)), ("duration", 1.5, "seconds", (3, 12)))),
            ("trackCount", 1, "CASE WHEN f_n_tracks IS NULL THEN 0.5 WHEN f_n_tracks = r_n_tracks THEN 1 ELSE 0.2 END", "r_n_tracks IS NOT NULL"), ("discCount", 1, "CASE WHEN coalesce(nullif(f_size % 3, 0), 1) = r_size % 3 + 1 THEN 1 ELSE 0.3 END", "r_size % 3 + 1 > 1"),
            ("year", 1.5, "CASE WHEN f_year = r_year THEN 1 WHEN abs(f_year - r_year) <= 1 THEN 0.6 ELSE 0.1 END", "true"), ("barcode", 6, "CASE WHEN f_barcode = r_barcode THEN 1 ELSE 0 END", "r_barcode IS NOT NULL"), ("catalog", 4, "CASE WHEN f_catalog = r_catalog THEN 1 ELSE 0 END", "true"),
        ]
    )
)
ORACLE["match_release"] = f"""
WITH f AS (SELECT {_SIDE}, p_size AS size FROM part), r AS (SELECT * FROM f WHERE id IN (SELECT min(p_partkey) FROM part GROUP BY p_brand, p_type)),
p AS (
  SELECT f.id AS file_id, r.id AS release_id, {_form('f.p_name')} AS x, {_form('r.p_name')} AS y, {_form("f.p_brand || ' the band'")} AS ax, {_form("'The ' || f.p_brand")} AS ay, {", ".join(f"{t}.{c} AS {t}_{c}" for t in "fr" for c in ("track", "seconds", "n_tracks", "year", "barcode", "catalog", "size"))}
  FROM f JOIN r ON f.p_brand = r.p_brand AND f.p_type = r.p_type
), b AS (SELECT *, {_J} AS j, {_jaccard("ax", "ay")} AS aj FROM p),
s AS ({_RELEASED}),
c AS (SELECT file_id, release_id, floor(100 * sum(s * w) / sum(w) + 0.5)::INT AS confidence, count(*)::INT AS n_signals, string_agg(signal, ',' ORDER BY s * w DESC, i) AS signals FROM s GROUP BY 1, 2)
SELECT file_id, release_id, confidence, coalesce(f_barcode <> r_barcode, false) AS blocked, CASE WHEN confidence >= 92 THEN 'certain' WHEN confidence >= 80 THEN 'likely' WHEN confidence >= 60 THEN 'possible' ELSE 'unlikely' END AS verdict, n_signals, signals FROM c JOIN b USING (file_id, release_id)"""

_TITLES = "t AS (SELECT list_sort(list_distinct(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || (p_size % 10)), ' '))) AS w, min(p_partkey) AS id FROM part GROUP BY 1)"
_MET = "met AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS common, len(a.w) + len(b.w) AS n FROM t a JOIN t b ON {})"
ORACLE["set_join"] = f"WITH {_TITLES}, {_MET.format('a.id < b.id')} SELECT a, b, common, round(common / (n - common)::DOUBLE, 9) AS score FROM met WHERE common >= 0.6 * (n - common)"
ORACLE["release_join"] = f"""WITH {_TITLES}, {_MET.format('a.id % 2 = 1 AND b.id % 2 = 0')}, s AS (SELECT a, b, common / (n - common)::DOUBLE AS score FROM met WHERE 2 * common >= n - common)
SELECT a, count(*) AS n_found, arg_min(b, (-score, b)) AS best, round(max(score), 9) AS score FROM s GROUP BY 1"""
ORACLE["tolerance_pairs"] = """
SELECT c_custkey, s_suppkey, 'same' AS how FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal BETWEEN s_acctbal - 300 AND s_acctbal + 300
UNION ALL SELECT c_custkey, s_suppkey, 'near' FROM customer JOIN supplier ON abs(c_nationkey - s_nationkey) = 1 AND c_acctbal BETWEEN s_acctbal - 40 AND s_acctbal + 40"""
ORACLE["similar_names"] = f"""
WITH p AS (SELECT p_partkey, p_brand, {_form('p_name')} AS f FROM part), n AS (SELECT DISTINCT p_brand, f FROM p WHERE f <> ''),
q AS (SELECT a.p_brand, a.f AS x, b.f AS y FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.f < b.f), r AS (SELECT *, {_J} AS j FROM q),
s AS (SELECT * FROM (SELECT p_brand, x AS a, y AS b, round(({_SIM})::DOUBLE, 6) AS score FROM r) WHERE score >= 0.4)
SELECT s.p_brand, a, b, score, f AS form, p_partkey FROM s JOIN p ON p.p_brand = s.p_brand AND f IN (a, b)
UNION ALL SELECT p_brand, f, NULL, 1.0, f, p_partkey FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, f) AS k FROM p WHERE f <> '') WHERE k > 1"""
_RUNS = "SELECT {0}, i, array_to_string(w[i : i + {1} - 1], ' ') AS run FROM (SELECT {0}, w, unnest(generate_series(1, len(w) - {1} + 1)) AS i FROM {2} WHERE len(w) >= {1}{3})"
_HITS = " UNION ".join(
    f"SELECT doc_id, item_id, x.i - y.i AS start FROM ({_RUNS.format('doc_id', k, 'd', '')}) x JOIN ({_RUNS.format('item_id', k, 'b', '' if k == SHINGLE else f' AND len(w) = {k}')}) y USING (run)" for k in range(1, SHINGLE + 1)
)
ORACLE["benchmark_passages"] = f"""
WITH b AS (SELECT item_id, item, string_split(item, ' ') AS w FROM (SELECT item_id, {_form('text')} AS item FROM benchmark) WHERE item <> ''), d AS (SELECT doc_id, string_split({_form('text')}, ' ') AS w FROM documents),
hits AS ({_HITS}),
m AS (SELECT doc_id, item_id, item AS y, array_to_string(d.w[greatest(start, 0) + 1 : start + len(b.w)], ' ') AS x FROM hits JOIN b USING (item_id) JOIN d USING (doc_id)), r AS (SELECT *, {_J} AS j FROM m)
SELECT doc_id, item_id, max(round(({_SIM})::DOUBLE, 6)) AS best, bool_or(contains(x, y)) AS whole FROM r GROUP BY 1, 2"""
