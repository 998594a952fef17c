"""PII by information-theoretic sanitisation, in DataFrame functions only.

Patterns find protected entities (addresses of mail and hosts, card and phone numbers). The terms (runs of three letters or more) of a
text that holds an entity are its context. An entity counts as its exact value and as coarser values (mail domain and local name,
networks of an address, leading digits of a number), so values that stand in one text each have evidence in common. Over the whole
corpus, the pointwise mutual information of a term and a value, log(P(value | term) / P(value)), says how many of the
log(N / n(value)) bits that single the value out the term gives away. P(value | term) is smoothed: PRIOR more texts with the
term are assumed that hold the value as often as all texts do. Terms that give away DISCLOSES of the bits or more are generalised
wherever they stand in a text with the value, those from REVEALS on are removed. All counts are of different texts: copies of a
text are evidence once, and a term that meets a value in fewer than EVIDENCE texts gives nothing away, as every word of a text that
stands nowhere else would.

Terms and values of a text are not all paired. Of values that stand in the same texts, one counts for all. A pair that matters stands
in two texts or more, so each term is paired with the values of its texts but the one of most values, which is looked up for the
pairs found elsewhere. A text of many values, however long, thus makes no pairs by itself.

Positions are code points. Each kind is matched leftmost and without overlaps; a match that fails its test is dropped. The patterns
are written so that each start of a run is tried once and runs are not given back, so very long runs take linear time; the
matches are those of the plain patterns.

Defined results: a null text is an empty one, without spans; rows that repeat doc_id and text get the same spans each; null doc_ids
are one id; other columns stay; an empty table gives an empty result.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

PRIOR, DISCLOSES, REVEALS, EVIDENCE = 2.0, 0.8, 0.95, 2
#: Matches that are folded together, and spans of a text that each of its terms is held against.
BLOCK, FEW = 256, 64
#: Terms (8 bytes each) up to which candidates are broadcast to the count of terms; beyond, they are joined by a shuffle.
BROADCAST_TERMS = 500_000

KINDS = ("email", "ip", "card", "phone")
#: A mail address may begin where the last match ended, or at the start of a run of its characters, and nowhere else.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}+"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _blocks(xs: Column) -> Column:
    """The array cut into arrays of BLOCK elements. Folds that append are done block by block, so that long arrays take linear time."""
    last = F.greatest(F.ceil(F.size(xs) / BLOCK), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))


def _before(lengths: Column) -> Column:
    """The sum of what stands before each element of an array of numbers."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def finds(text: Column, pattern: str) -> Column:
    """An array of (s, e, m): where each match starts and ends, and what it is. What lies between matches gives the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def placed(xs: Column, at: Column) -> Column:
        return F.aggregate(xs, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    def all_placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["m"])))
        return F.flatten(F.zip_with(blocks, _before(sizes), placed))

    own = F.filter(steps, lambda x: x["m"].isNotNull())
    return once(own, lambda xs: F.when(F.size(xs) <= BLOCK, placed(xs, F.lit(0))).otherwise(once(_blocks(xs), all_placed)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """An array of (s, k, e, entity), sorted; k counts the kinds."""
    tests = (
        (EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True), lambda m: F.lower(m)),
        (IP, text.rlike("[0-9]\\.[0-9]"), lambda m: m.rlike("^" + "\\.".join([PART] * 4) + "$"), lambda m: m),
        (CARD, text.rlike("[0-9]"), lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)), _digits),
        (PHONE, F.contains(text, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15), _digits),
    )
    none = F.array().cast("array<struct<s:int,k:int,e:int,entity:string>>")

    def of_kind(k: int, pattern: str, may: Column, good, name) -> Column:
        found = F.filter(finds(text, pattern), lambda x: good(x["m"]))
        return F.when(may, F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.concat(F.lit(KINDS[k] + ":"), name(x["m"])).alias("entity")))).otherwise(none)

    return F.array_sort(F.concat(*(of_kind(k, *test) for k, test in enumerate(tests))))


def levels(entity: Column) -> Column:
    """Hashes of the values that an entity counts as: its own and coarser ones, each with the name of its level."""
    kind, value = F.substring_index(entity, ":", 1), F.regexp_replace(entity, "^[a-z]+:", "")
    part = lambda name, c: F.concat(F.lit(name), c)
    coarse = F.when(kind == "email", F.array(part("domain:", F.substring_index(value, "@", -1)), part("local:", F.substring_index(value, "@", 1))))
    coarse = coarse.when(kind == "ip", F.array(part("net3:", F.substring_index(value, ".", 3)), part("net2:", F.substring_index(value, ".", 2))))
    coarse = coarse.otherwise(F.array(F.concat(kind, F.lit("4:"), F.substring(value, 1, 4)), F.concat(kind, F.lit("6:"), F.substring(value, 1, 6))))
    return F.transform(F.concat(F.array(entity), coarse), lambda x: F.xxhash64(x))


def terms_of(texts: DataFrame) -> DataFrame:
    """(digest, term) of each term of texts, as often as it comes."""
    words = texts.select("digest", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("word"))
    return words.select("digest", F.xxhash64(F.lower("word")).alias("term"))


def _all_places(texts: DataFrame, more: list[str]) -> DataFrame:
    """(digest, term, s, e, more) of each term of texts, by a sum over the terms before it. Rows, so that long texts take linear time."""
    hits, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    steps = F.zip_with(gaps, hits, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), F.xxhash64(F.lower(m)).alias("term")))
    rows = texts.select("digest", *more, F.posexplode(steps).alias("i", "x")).where("x.len IS NOT NULL")
    before = Window.partitionBy("digest").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("e", F.sum(F.col("x.gap") + F.col("x.len")).over(before).cast("int"))
    return rows.select("digest", *more, "x.term", (F.col("e") - F.col("x.len")).alias("s"), "e")


def places(texts: DataFrame, few: int = FEW) -> DataFrame:
    """(digest, term, s, e) of each term of texts (digest, text, base), outside the spans of base.

    Terms of texts with few spans are held against each of them; those of texts with more meet the spans in the order of their places.
    """
    usual = _all_places(texts.where(F.size("base") <= few), ["base"]).where(~F.exists("base", lambda z: (F.col("s") < z["e"]) & (z["s"] < F.col("e")))).drop("base")
    large = texts.where(F.size("base") > few)
    rows = _all_places(large, []).withColumn("kind", F.lit(1))
    spans = large.select("digest", F.explode("base").alias("z")).select("digest", F.lit(None).cast("long").alias("term"), "z.s", "z.e", F.lit(0).alias("kind"))
    # Terms don't overlap each other, so one that reaches into a span that starts later has it as the next row.
    place = Window.partitionBy("digest").orderBy("s", "kind", "e")
    until = F.max(F.when(F.col("kind") == 0, F.col("e"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(F.when(F.col("kind") == 0, F.col("s"))).over(place)
    rows = rows.unionByName(spans).withColumns({"until": until, "after": after})
    return usual.unionByName(rows.where("kind = 1 AND (until IS NULL OR until <= s) AND (after IS NULL OR after >= e)").select("digest", "term", "s", "e"))


def digest_of(text: Column | str) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text))


def _row_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"own_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "digest": digest_of("text")})


def _most(n: int, n_both: Column, n_key: Column) -> Column:
    """The number of texts up to which a term that n_both texts share with a value of n_key texts can have a share of DISCLOSES."""
    return (n_both + PRIOR * n_key / max(n, 1)) * F.pow(F.lit(float(n)) / n_key, F.lit(1 - DISCLOSES)) * (1 + 1e-9) - PRIOR


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each row of docs (doc_id, own_id, digest, base as of base_spans), and one for each digest with disclosing terms (digest, extra: an array of (s, e, removed))."""
    d = _row_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    found = d.withColumn("base", base_spans(F.col("text")))
    found = scratch(found.select("doc_id", "own_id", "digest", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "pii")

    n = found.select("digest").distinct().count()
    held = scratch(found.where("size(base) > 0").groupBy("digest").agg(F.first(F.struct("text", "base")).alias("x")).select("digest", "x.*"), "pii-texts")
    keys = held.select("digest", F.explode(F.array_distinct(F.flatten(F.transform("base.entity", levels)))).alias("key"))
    code = F.xxhash64("digest")
    values = keys.groupBy("key").agg(F.count("*").alias("n_key"), F.bit_xor(code).alias("x"), F.bit_xor(F.xxhash64(code, F.lit(1))).alias("y")).where(F.col("n_key") >= EVIDENCE)
    values = values.groupBy("n_key", "x", "y").agg(F.min("key").alias("key")).select("key", "n_key", _most(n, F.col("n_key"), F.col("n_key")).alias("most"))
    keys = scratch(keys.join(values, "key"), "pii-keys")
    of_text = keys.groupBy("digest").agg(F.count("*").alias("n_keys"), F.max("most").alias("most"))
    # A term reaches DISCLOSES only if few enough texts hold it. The texts with entities that hold it are a lower bound of their number,
    # which rules out common terms before they meet values, and before the corpus is searched for the others.
    context = places(held.join(of_text.select("digest"), "digest", "left_semi")).select("digest", "term").distinct()
    context = scratch(context.join(of_text, "digest"), "pii-context")
    least = context.groupBy("term").agg(F.count("*").alias("least"), F.max("most").alias("top"), F.max(F.struct("n_keys", "digest")).alias("heavy"))
    least = least.where((F.col("least") >= EVIDENCE) & (F.col("least") <= F.col("top"))).select("term", "least", F.col("heavy.digest").alias("heavy"))
    light = context.join(least, "term").where("digest <> heavy AND least <= most").drop("most")
    pairs = scratch(light.join(keys, "digest").where("least <= most").select("digest", "term", "key", "n_key", "least", "heavy"), "pii-pairs")
    seen = pairs.groupBy("key", "term").agg(F.count("*").alias("n_light"), *(F.any_value(c).alias(c) for c in ("n_key", "least", "heavy")))
    seen = seen.join(keys.select(F.col("digest").alias("heavy"), "key", F.lit(1).alias("also")), ["heavy", "key"], "left").withColumn("n_both", F.col("n_light") + F.coalesce("also", F.lit(0)))
    seen = scratch(seen.where((F.col("n_both") >= EVIDENCE) & (F.col("least") <= _most(n, F.col("n_both"), F.col("n_key")))), "pii-seen")
    terms = seen.select("term").distinct()
    n_terms = terms.count()
    disclosing = seen.select("key", "term", "heavy", "also", F.lit(0.0).alias("share")).limit(0)
    if n_terms:
        terms = F.broadcast(terms) if n_terms <= BROADCAST_TERMS else terms
        n_term = terms_of(d).join(terms, "term", "left_semi").groupBy("term", "digest").agg(F.count("*")).groupBy("term").agg(F.count("*").alias("n_term"))
        given = (F.col("n_both") + PRIOR * F.col("n_key") / n) / (F.col("n_term") + PRIOR)
        share = F.try_divide(F.log2(given * n / F.col("n_key")), F.log2(F.lit(float(n)) / F.col("n_key")))
        disclosing = scratch(seen.join(n_term, "term").select("key", "term", "heavy", "also", share.alias("share")).where(f"share >= {DISCLOSES}"), "pii-disclosing")
    hidden = pairs.join(disclosing.select("key", "term", "share"), ["key", "term"]).select("digest", "term", "share")
    hidden = hidden.unionByName(disclosing.where("also = 1").select(F.col("heavy").alias("digest"), "term", "share"))
    hidden = hidden.groupBy("digest", "term").agg(F.max("share").alias("share"))
    texts = held.join(hidden.select("digest").distinct(), "digest", "left_semi")
    extra = places(texts).join(hidden, ["digest", "term"])
    extra = extra.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("s", "e", (F.col("share") >= REVEALS).alias("removed")))).alias("extra"))
    # As a table, the one row of each text with terms is not yet dealt out by digest, so that Spark can split the rows of a text with many copies.
    return found.drop("text"), scratch(extra, "pii-extra")


NONE = "array<struct<s:int,e:int,removed:boolean>>"


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """rows (digest, base) with extra. Rows without an entity have no terms to hide, so they are not dealt out; there are many, and many alike."""
    none = F.array().cast(NONE)
    some = rows.where("size(base) > 0").join(extra, "digest", "left").withColumn("extra", F.coalesce("extra", none))
    return some.unionByName(rows.where("size(base) = 0").withColumn("extra", none))


def find_spans(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, own_id, digest, base (as base_spans) and extra, an array of (s, e, removed) of disclosing terms."""
    return _with_extra(*_spans(docs)).select("doc_id", "own_id", "digest", "base", "extra")


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, [*KINDS, "term"])), x["k"]), x["s"], x["e"])), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each kind, base_sha256 and spans."""
    f = find_spans(docs)
    slim = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    more = F.transform("extra", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e")))
    counts = [F.size(F.array_remove(F.col("base.k"), k)) for k in range(len(KINDS))]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{name}") for n, name in zip(counts, KINDS)]
    return f.select("doc_id", *counts, F.sha2(shown(slim), 256).alias("base_sha256"), shown(F.array_sort(F.concat(slim, more))).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with entities replaced by their kind in brackets, disclosing terms by [TERM] or nothing, and n_chars to match."""
    _, extra = _spans(docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("old"))
    both = _with_extra(rows.withColumns({"digest": digest_of("old"), "base": base_spans(F.col("old"))}), extra)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(marks, x["k"]).alias("mark"))), F.transform("extra", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["removed"], "").otherwise("[TERM]").alias("mark")))))
    old = F.col("old")

    def written(text: Column, xs: Column, at: Column) -> Column:
        """text, which begins at code point at, with its spans replaced. An overlapping span adds its mark, and no text twice."""

        def step(acc: Column, x: Column) -> Column:
            piece = F.concat(F.substring(text, acc["at"] - at + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), x["mark"])
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

        return F.aggregate(xs, F.struct(at.alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] - at + 1, F.length(text))))

    def by_block(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda xs: F.array_max(F.transform(xs, lambda x: x["e"])))
        starts = once(ends, lambda es: F.transform(es, lambda e, i: F.when(i == 0, 0).otherwise(F.array_max(F.slice(es, F.lit(1), i)))))
        return once(starts, lambda ss: F.array_join(F.zip_with(blocks, F.transform(ss, lambda s, i: F.struct(s.alias("s"), F.get(ss, i + 1).alias("e"))), part), ""))

    def part(xs: Column, at: Column) -> Column:
        text = F.substring(old, at["s"] + 1, F.coalesce(at["e"] - at["s"], F.length(old)))
        return once(text, lambda t: written(t, xs, at["s"]))

    end = F.when(F.size("spans") <= BLOCK, written(old, F.col("spans"), F.lit(0))).otherwise(once(_blocks(F.col("spans")), by_block))
    both = both.withColumn("spans", spans).withColumn("new", F.when(F.size("spans") > 0, end).otherwise(F.col("old")))
    keep = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return both.select(*[keep[c].alias(c) if c in keep else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
