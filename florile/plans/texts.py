"""Queries: cleaning, replacing, dates, numbers, formats, paths."""

from pyspark.sql import functions as F

from ..functions import arrow, text
from ..operators import cleanup, replace
from . import tables


def clean_whitespace(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.sha2(text.collapse_spaces(text.trim(F.col("text"))), 256).alias("cleaned"))


def clean_quotes(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.sha2(text.punctuation(text.apostrophes(text.straight_quotes(F.col("text")))), 256).alias("cleaned"))


def clean_prefix(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    return p.select("p_partkey", text.remove_prefixes(F.col("p_name"), ["blue", "hot", "red"]).alias("cleaned"))


def clean_separators(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.collapse_separators(F.translate("text", ".\n", ",;")), 256).alias("cleaned"))


def clean_featuring(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    raw = F.concat("p_brand", F.lit(" FT. "), "p_name", F.lit(" (featuring "), "p_type", F.lit(")"))
    return p.select("p_partkey", text.featuring(raw).alias("cleaned"))


def clean_case(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.sentence_case(F.col("text"), by_letter=True), 256).alias("sentence"), F.sha2(text.upper_by_letter(F.col("source")), 256).alias("upper"))


def clean_html_named(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", F.sha2(text.named_entities(F.col("html")), 256).alias("cleaned"))


def clean_unicode(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.drop_invisible(arrow.nfc(F.col("text"))), 256).alias("cleaned"))


def clean_empty(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (text.empty_if_blank(F.col("text")) == "").alias("emptied"), (text.empty_if_blank(F.col("role")) == "").alias("role_emptied"))


def clean_distinct_values(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    raw = F.concat(F.split("p_name", " "), F.array(F.upper(F.substring_index("p_name", " ", 1)), F.lit(" "), F.col("p_brand")))
    return p.select("p_partkey", F.array_join(cleanup.distinct_values(raw), "|").alias("cleaned"))


def clean_genre(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    return p.select("p_partkey", cleanup.genre(F.concat(F.lit(" "), F.lower("p_type")), {"eco": "Economy", "std": "Standard"}, ["ECONOMY", "STANDARD", "PROMO"]).alias("genre"))


def clean_pipeline(spark, sf_dir):
    """Several operations in their order over text and date fields, and what changed."""
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_orderpriority", F.lit("  x ")).alias("title"), F.date_format("o_orderdate", "yyyy/M/d").alias("date"), F.lit(1).alias("year"))
    steps = [cleanup.Step("trim", ("title", "date")), cleanup.Step("collapseSpaces", ("title",)), cleanup.Step("normalizeDates", ("date",))]
    return cleanup.change_rows(cleanup.clean(o, steps, "date", "year"), "o_orderkey")


def normalize_date(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    slashed = F.date_format("o_orderdate", "yyyy/M/d")
    noisy = F.concat(F.lit("c. "), F.year("o_orderdate").cast("string"), F.lit(" (remastered)"))
    return o.select("o_orderkey", text.normal_dates(slashed, {"iso": "auto", "y": "year", "ym": "year-month"}).alias("d"), text.normal_date(noisy).alias("noisy"), text.first_year(noisy).alias("year")).select("o_orderkey", "d.*", "noisy", "year")


def clean_title_case(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    raw = F.concat(F.lit("of the "), F.lower("p_brand"), F.lit(" via "), F.upper("p_type"), F.lit(" v. "), F.col("p_name"), F.lit(" iPod with"))
    return p.select("p_partkey", arrow.title_case(raw).alias("title"))


def clean_defaults(spark, sf_dir):
    """The default operations in their order over a title, a list of artists, a track number and a date inside a text."""
    p = tables.read(spark, sf_dir, "part")
    raw = p.select("p_partkey", F.concat(F.lit("  - it´s "), "p_name", F.lit("   x \u200b ")).alias("title"), F.array(F.col("p_brand"), F.upper("p_brand"), F.lit("  "), F.concat("p_type", F.lit(" "))).alias("artists"), (F.col("p_retailprice") - 1000).alias("track"), F.concat(F.lit("ca. 1990/"), F.col("p_size") % 12 + 1, F.lit(" x")).alias("date"), F.lit(None).cast("int").alias("year"))
    steps = cleanup.default_steps(("title", "artists"), ("title",), ("artists",), ("track",), ("date",))
    out = cleanup.clean(raw, steps, "date", "year")
    return out.select("p_partkey", "title", F.array_join("artists", "|").alias("artists"), "track", "date", "year", F.array_join("changes.field", ",").alias("changed"))


def clean_genre_names(spark, sf_dir):
    """Spellings of genres by the built-in tables."""
    p = tables.read(spark, sf_dir, "part")
    names = F.array(*map(F.lit, [" hip hop", "DNB", "rock & roll ", "techno", "SHOEGAZE", "no genre", "R & B"]))
    return p.select("p_partkey", cleanup.genre(F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("genre"))


def normalize_date_text(spark, sf_dir):
    """Dates inside texts: whole ones, months, years amid noise, several numbers, and none."""
    o = tables.read(spark, sf_dir, "orders")
    slashed = F.date_format("o_orderdate", "yyyy/M/d")
    texts = [F.concat(F.lit("Released "), slashed, F.lit(" (x)")), F.concat(F.lit(" in "), F.date_format("o_orderdate", "yyyy.M"), F.lit(" ")), F.concat(F.lit("about "), F.year("o_orderdate").cast("string")), F.concat(F.year("o_orderdate").cast("string"), F.lit(" or 2001")), F.lit("  nothing "), F.lit(None).cast("string")]
    raw = F.element_at(F.array(*texts), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", text.normal_dates(raw, {"auto": "auto", "y": "year", "whole": "full"}).alias("d")).select("o_orderkey", "d.*")


def number_prefix(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    n, total = text.pair(F.concat(F.substring("o_orderpriority", 1, 1), F.lit("/"), F.lit("5")))
    return o.select("o_orderkey", text.leading_number(F.col("o_orderpriority")).alias("n"), n.alias("first"), total.alias("total"), text.leading_number(F.col("o_orderstatus")).alias("none"))


def duration_parse(spark, sf_dir):
    """m:ss texts made of sizes, read back as seconds."""
    p = tables.read(spark, sf_dir, "part")
    shown = text.show_duration(F.col("p_size") * 97)
    return p.select("p_partkey", shown.alias("shown"), text.seconds(shown).cast("long").alias("seconds"))


def replace_literal(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    return p.select("p_partkey", replace.replaced(F.col("p_name"), "RED", "$1x", once=False).alias("every"), replace.replaced(F.col("p_name"), "e", "E", ignore_case=False, once=True).alias("once"), replace.replaced(F.col("p_brand"), "brand#11", "B", whole=True).alias("whole"))


def replace_regex_groups(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    return c.select("c_custkey", replace.replaced(F.col("c_name"), r"(\w+)#0*(\d+)", "$2-$1", regex=True).alias("name"))


def replace_hits(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", replace.hits(F.col("text"), "the").cast("long").alias("n"), replace.hits(F.col("text"), "[0-9]+", regex=True).cast("long").alias("numbers"))


def split_multi_edit(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    values = replace.split_values(F.translate("p_name", " ", "/"))
    return p.select("p_partkey", F.array_join(values, "|").alias("parts"), F.size(values).alias("n"))


def action_steps(spark, sf_dir):
    """Steps that each read the record as it was."""
    o = tables.read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", text.first_year(day).alias("year"), replace.date_in_style(day, "day").alias("date"), replace.strip_featured(F.concat("o_orderpriority", F.lit(" (feat. x)"))).alias("artist"), replace.track_from_name(F.col("o_orderpriority")).alias("track"))


def sweep_empty(spark, sf_dir):
    """Fields that hold blanks only."""
    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\S", "").alias("blanks"), "lang", F.when(F.col("doc_id") % 3 == 0, " \t").otherwise(F.col("source")).alias("source"))
    return d.select("doc_id", F.array_join(replace.empty_fields(["blanks", "lang", "source"]), ",").alias("fields"))


def bytes_text(spark, sf_dir):
    """Texts as base64 and hexadecimal of their bytes, and back."""
    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return d.select("doc_id", F.sha2(text.base64_text(F.col("raw")), 256).alias("base64"), F.sha2(F.hex("raw"), 256).alias("hex"), F.sha2(F.decode(F.unbase64(text.base64_text(F.col("raw"))), "UTF-8"), 256).alias("back"), F.octet_length("raw").cast("long").alias("n"))


def path_split(spark, sf_dir):
    p = tables.read(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")
    return p.select("page_id", text.folder_of(path).alias("folder"), text.name_of(path).alias("name"), text.extension_of(text.folder_of(path)).alias("ext"), text.stem_of(text.folder_of(path)).alias("stem"))


def format_values(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    n = F.col("n_chars")
    return d.select("doc_id", text.show_bytes(n * n).alias("bytes"), text.show_duration(n).alias("duration"), text.show_bitrate(n * 10).alias("bitrate"), text.show_sample_rate(n * 100).alias("rate"))


def content_hash(spark, sf_dir):
    from ..sources.files import content_hash as digest

    return tables.read(spark, sf_dir, "documents").select("doc_id", digest(F.encode("text", "UTF-8")).alias("sha256"))


def title_parts(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    artist, title = text.title_split(F.concat("p_brand", F.lit(" - "), "p_name", F.lit(" - "), "p_type"))
    return p.select("p_partkey", artist.alias("artist"), title.alias("title"))


QUERIES = {
    f.__name__: f
    for f in (clean_whitespace, clean_quotes, clean_prefix, clean_separators, clean_featuring, clean_case, clean_html_named, clean_unicode, clean_empty, clean_distinct_values, clean_genre, clean_genre_names, clean_title_case, clean_defaults, clean_pipeline, normalize_date, normalize_date_text, number_prefix, duration_parse, replace_literal, replace_regex_groups, replace_hits, split_multi_edit, action_steps, sweep_empty, bytes_text, path_split, format_values, content_hash, title_parts)
}

_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_TRIMMED = f"regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
ORACLE = {
    "clean_whitespace": f"SELECT conv_id, turn, sha256(regexp_replace({_TRIMMED}, '[ \\t\\x{{A0}}]{{2,}}', ' ', 'g')) AS cleaned FROM conversations",
    "clean_quotes": "SELECT conv_id, turn, sha256(replace(translate(translate(translate(text, '“”„‘’‚', '\"\"\"'''''''), 'ʼ‘`´’', ''''''''''''), '–— ', '-- '), '…', '...')) AS cleaned FROM conversations",
    "clean_prefix": f"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)^([{_SPACE}]*(blue|hot|red))+') THEN regexp_replace(regexp_replace(p_name, '(?i)^([{_SPACE}]*(blue|hot|red))+', ''), '^[-–—_:,{_SPACE}]+', '') ELSE p_name END AS cleaned FROM part",
    "clean_featuring": r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_brand || ' FT. ' || p_name || ' (featuring ' || p_type || ')', '(?i)([(\[])\s*(?:featuring|feat|ft)\.?\s+', '\1feat. ', 'g'), '(?i)(\s)(?:featuring|feat|ft)\.?\s+', '\1feat. ', 'g'), ' {2,}', ' ', 'g') AS cleaned FROM part",
    "clean_html_named": "SELECT page_id, sha256(" + "replace(" * 13 + "html" + "".join(f", '&{k};', '{v}')" for k, v in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("amp", "&"))) + ") AS cleaned FROM pages",
    "clean_unicode": r"SELECT doc_id, sha256(regexp_replace(nfc_normalize(text), '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')) AS cleaned FROM documents",
    "clean_empty": f"SELECT conv_id, turn, regexp_matches(text, '^[{_SPACE},;/|]*$') AS emptied, regexp_matches(role, '^[{_SPACE},;/|]*$') AS role_emptied FROM conversations",
    "clean_distinct_values": "WITH w AS (SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), [upper(split_part(p_name, ' ', 1)), ' ', p_brand])) AS v, generate_subscripts(list_concat(string_split(p_name, ' '), ['', ' ', p_brand]), 1) AS i FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(trim(v)) ORDER BY i) AS r FROM w WHERE trim(v) <> '') SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS cleaned FROM f WHERE r = 1 GROUP BY 1",
    "clean_genre": "SELECT p_partkey, CASE lower(p_type) WHEN 'eco' THEN 'Economy' WHEN 'std' THEN 'Standard' WHEN 'economy' THEN 'ECONOMY' WHEN 'standard' THEN 'STANDARD' WHEN 'promo' THEN 'PROMO' ELSE trim(lower(p_type)) END AS genre FROM part",
    "clean_pipeline": "SELECT o_orderkey, field, before, after FROM (SELECT o_orderkey, 'title' AS field, ' ' || o_orderpriority || '  x ' AS before, o_orderpriority || ' x' AS after FROM orders UNION ALL SELECT o_orderkey, 'date', year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate), strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT o_orderkey, 'year', '1', year(o_orderdate)::VARCHAR FROM orders)",
    "normalize_date": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, year(o_orderdate)::VARCHAR AS y, strftime(o_orderdate, '%Y-%m') AS ym, year(o_orderdate)::VARCHAR AS noisy, year(o_orderdate)::INT AS year FROM orders",
    "number_prefix": "SELECT o_orderkey, left(o_orderpriority, 1)::INT AS n, left(o_orderpriority, 1)::INT AS first, 5::INT AS total, NULL::INT AS none FROM orders",
    "duration_parse": "SELECT p_partkey, CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE s // 60 || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS shown, s AS seconds FROM (SELECT p_partkey, (p_size * 97)::BIGINT AS s FROM part)",
    "replace_literal": "SELECT p_partkey, regexp_replace(p_name, '(?i)red', '$1x', 'g') AS every, regexp_replace(p_name, 'e', 'E') AS once, CASE WHEN lower(p_brand) = 'brand#11' THEN 'B' ELSE p_brand END AS whole FROM part",
    "replace_regex_groups": r"SELECT c_custkey, regexp_replace(c_name, '(?i)([A-Za-z0-9_]+)#0*([0-9]+)', '\2-\1', 'g') AS name FROM customer",
    "replace_hits": "SELECT doc_id, len(regexp_extract_all(text, '(?i)the'))::BIGINT AS n, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers FROM documents",
    "split_multi_edit": "SELECT p_partkey, replace(p_name, ' ', '|') AS parts, len(string_split(p_name, ' '))::INT AS n FROM part",
    "action_steps": "SELECT o_orderkey, year(o_orderdate)::INT AS year, year(o_orderdate) || '-01-01' AS date, o_orderpriority AS artist, left(o_orderpriority, 1)::INT AS track FROM orders",
    "path_split": r"WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', ''), '^/+', '') AS path FROM pages), f AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder FROM p) SELECT page_id, folder, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(folder, '^.+\.([^.]*)$', 1)) AS ext, regexp_replace(folder, '^(.+)\.[^.]*$', '\1') AS stem FROM f",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "title_parts": "SELECT p_partkey, p_brand || ' - ' || p_name AS artist, p_type AS title FROM part",
}
_SEPARATED = f"regexp_replace(regexp_replace(regexp_replace(translate(text, '.' || chr(10), ',;'), '[,;][{_SPACE}]*([,;.])', '\\1', 'g'), '[{_SPACE}]*([,;])[{_SPACE}]*([,;])', '\\1\\2', 'g'), '[{_SPACE},;:-]+$', '')"
ORACLE["clean_separators"] = f"SELECT doc_id, sha256({_SEPARATED}) AS cleaned FROM documents"
ORACLE["clean_case"] = r"SELECT doc_id, sha256(CASE WHEN regexp_matches(lower(text), '^\p{L}') THEN upper(left(lower(text), 1)) || substr(lower(text), 2) ELSE lower(text) END) AS sentence, sha256(upper(source)) AS upper FROM documents"
ORACLE["clean_title_case"] = r"""
WITH w AS (
  SELECT p_partkey, unnest(string_split('of the ' || lower(p_brand) || ' via ' || upper(p_type) || ' v. ' || p_name || ' iPod with', ' ')) AS w,
    generate_subscripts(string_split('of the ' || lower(p_brand) || ' via ' || upper(p_type) || ' v. ' || p_name || ' iPod with', ' '), 1) AS i FROM part
)
SELECT p_partkey, string_agg(CASE WHEN i > 1 AND list_contains(['a', 'an', 'and', 'as', 'at', 'but', 'by', 'for', 'in', 'nor', 'of', 'on', 'or', 'per', 'the', 'to', 'v', 'via', 'vs'], replace(lower(w), '.', '')) THEN lower(w)
  WHEN w = 'iPod' THEN w ELSE upper(left(w, 1)) || lower(substr(w, 2)) END, ' ' ORDER BY i) AS title FROM w GROUP BY 1"""
ORACLE["clean_defaults"] = "SELECT p_partkey, 'it''s ' || p_name || ' x' AS title, p_brand || '|' || p_type AS artists, CASE WHEN p_retailprice >= 1000 THEN floor(p_retailprice - 1000)::INT END AS track, '1990-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') AS date, 1990 AS year, 'title,artists,' || CASE WHEN p_retailprice < 1000 OR p_retailprice - 1000 <> floor(p_retailprice - 1000) THEN 'track,' ELSE '' END || 'date,year' AS changed FROM part"
ORACLE["clean_genre_names"] = "SELECT p_partkey, ['Hip-Hop', 'Drum & Bass', 'Rock', 'Techno', 'Shoegaze', 'no genre', 'R&B'][p_partkey % 7 + 1] AS genre FROM part"
ORACLE["normalize_date_text"] = """
SELECT o_orderkey,
  CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN year(d)::VARCHAR WHEN 3 THEN year(d) || ' or 2001' WHEN 4 THEN 'nothing' END AS auto,
  CASE k WHEN 3 THEN year(d) || ' or 2001' WHEN 4 THEN 'nothing' WHEN 5 THEN NULL ELSE year(d)::VARCHAR END AS y,
  CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN 'about ' || year(d) WHEN 3 THEN year(d) || ' or 2001' WHEN 4 THEN 'nothing' END AS whole
FROM (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 6 AS k FROM orders)"""
ORACLE["format_values"] = """
SELECT doc_id,
  CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1024 ** 2 THEN CASE WHEN n / 1024 < 10 THEN printf('%.1f', floor((n / 1024) * 10 + 0.5) / 10) ELSE floor(n / 1024 + 0.5)::BIGINT::VARCHAR END || ' KB'
       WHEN n < 1024 ** 3 THEN CASE WHEN n / 1024 ** 2 < 10 THEN printf('%.1f', floor((n / 1024 ** 2) * 10 + 0.5) / 10) ELSE floor(n / 1024 ** 2 + 0.5)::BIGINT::VARCHAR END || ' MB'
       ELSE CASE WHEN n / 1024 ** 3 < 10 THEN printf('%.1f', floor((n / 1024 ** 3) * 10 + 0.5) / 10) ELSE floor(n / 1024 ** 3 + 0.5)::BIGINT::VARCHAR END || ' GB' END AS bytes,
  CASE WHEN c >= 3600 THEN c // 3600 || ':' || lpad((c % 3600 // 60)::VARCHAR, 2, '0') || ':' ELSE c // 60 || ':' END || lpad((c % 60)::VARCHAR, 2, '0') AS duration,
  CASE WHEN c > 0 THEN floor(c * 10 / 1000 + 0.5)::BIGINT || ' kbps' ELSE '—' END AS bitrate,
  CASE WHEN c = 0 THEN '—' WHEN c * 100 % 1000 = 0 THEN c * 100 // 1000 || ' kHz' ELSE printf('%.1f', floor((c * 100 / 1000) * 10 + 0.5) / 10) || ' kHz' END AS rate
FROM (SELECT doc_id, n_chars AS c, n_chars * n_chars AS n FROM documents)"""
ORACLE["sweep_empty"] = f"SELECT doc_id, concat_ws(',', CASE WHEN text IS NOT NULL THEN 'blanks' END, CASE WHEN regexp_matches(lang, '^[{_SPACE}]*$') THEN 'lang' END, CASE WHEN doc_id % 3 = 0 OR regexp_matches(source, '^[{_SPACE}]*$') THEN 'source' END) AS fields FROM documents"
ORACLE["bytes_text"] = "SELECT doc_id, sha256(base64(encode(text))) AS base64, sha256(upper(hex(encode(text)))) AS hex, sha256(text) AS back, strlen(text)::BIGINT AS n FROM documents"
