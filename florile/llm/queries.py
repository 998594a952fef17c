"""The queries of this package: thin digests of what the operators return over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, fim, html_extract, language, licenses, line_dedup, near_dedup, negatives, packing, pieces, pii, quality


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text, and whether they decode to it."""
    model = vocabulary("piece_bpe_32k.model")
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = pieces.round_trip(docs, model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("same"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), vocabulary())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.by_document(_read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text transformed, and restored from its output and form."""
    out = fim.restored(fim.transform(_read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_read(spark, sf_dir, "embeddings"), negatives.moved_label(), F.col("vec_id") % negatives.EVERY == 0)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.learn(docs.where(~language.held_out("doc_id")))
    return language.identify(docs.select("doc_id", "text"), profiles).select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_pii, op3_line_dedup, op4_packing, op5_quality_classifier, op6_sentencepiece, op7_embedding_dedup, op8_exact_dedup, op9_html_extraction, op10_license_scan, op11_fill_in_middle, op12_hard_negatives, op13_language_id)}

ORACLE = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), shared AS (
  SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first_doc < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE first_doc IS NULL OR first_doc >= doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (k) GROUP BY doc_id""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}


_REACH = """, reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
part AS (SELECT a AS id, min(b) AS low FROM reach GROUP BY 1), degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)"""

ORACLE["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x20]+'), lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: hash(w[i : i + 4]))) AS s FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS id FROM documents){_REACH}
SELECT id AS doc_id, low AS class_id, coalesce(n, 0)::BIGINT AS n_links, id = low AS kept FROM part LEFT JOIN degree USING (id)"""

ORACLE["op7_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings){_REACH}
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, id = low AS kept FROM part LEFT JOIN degree USING (id)"""

_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES)
_GRAMS = """CASE WHEN len(w) > 1 THEN list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END"""
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
ORACLE["op10_license_scan"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), runs AS (
  SELECT *, sum((trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) = '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines
), paragraphs AS (
  SELECT doc_id, min(i) AS i, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS x FROM runs WHERE trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY doc_id, g
), units AS (
  SELECT doc_id, i, x FROM lines WHERE x <> '' UNION ALL SELECT doc_id, i, x FROM paragraphs WHERE n > 1
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE doc_id IN (SELECT doc_id FROM paragraphs GROUP BY 1 HAVING count(*) > 1)
), sets AS (SELECT doc_id, i, {_GRAMS} AS b FROM (SELECT *, {_WORDS.format('x')} AS w FROM units) WHERE len(w) >= 1),
templates AS (SELECT name, {_GRAMS} AS t FROM (SELECT name, {_WORDS.format('body')} AS w FROM (VALUES {_TEMPLATES}) AS v(name, body))),
found AS (SELECT doc_id, i, name, max(2.0::DOUBLE * len(list_intersect(b, t)) / (len(b) + len(t))) AS dice FROM sets JOIN templates ON len(b) BETWEEN 0.666 * len(t) AND 1.501 * len(t) GROUP BY doc_id, i, name, b)
SELECT doc_id, name AS license_id, count(*) AS n_units, round(max(dice), 9) AS best_dice, arg_min(i, (-dice, i))::BIGINT AS best_line FROM found WHERE dice >= 0.8 GROUP BY 1, 2"""

ORACLE["op11_fill_in_middle"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
  FROM cut
), parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""

ORACLE["op12_hard_negatives"] = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM own a JOIN own b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN met USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3"""

_CRC = """xor(list_reduce(flatten(list_prepend([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""
ORACLE["op13_language_id"] = f"""
WITH docs AS (SELECT doc_id, lang, coalesce({_CRC} % 4 = 2, false) AS held_out, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+'), ' ') || ' ' AS t FROM documents),
grams AS (
  SELECT doc_id, lang, held_out, g, count(*) AS n
  FROM (SELECT doc_id, lang, held_out, unnest(flatten(list_transform(generate_series(1, length(t)), lambda i: list_distinct([t[i:i], t[i:i + 1], t[i:i + 2]])))) AS g FROM docs)
  WHERE g <> ' ' AND g <> '' AND g[2:2] <> ' ' OR length(g) = 2 AND g[1:1] <> ' ' GROUP BY ALL
), own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r FROM grams QUALIFY r < 400),
learned AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS r FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY r < 400
), far AS (
  SELECT doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN 400 ELSE abs(p.r - own.r) END) AS d, count(*) AS m
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM learned) l LEFT JOIN learned p ON p.lang = l.lang AND p.g = own.g GROUP BY ALL
), best AS (SELECT doc_id, arg_min(lang, (d, lang)) AS lang_pred, 1 - min(d) / (400 * any_value(m))::DOUBLE AS score FROM far GROUP BY doc_id)
SELECT docs.doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(score, 0)::DOUBLE AS score FROM docs LEFT JOIN best USING (doc_id)"""
