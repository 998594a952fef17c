import random
import re
import unicodedata

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from florile import plans
from florile.functions import arrow, text
from florile.operators import cleanup, replace


def test_case_by_letter(spark, tmp_path):
    """clean_case and its SQL agree on texts that begin with, hold and end in any letter or sign."""
    con, every = duckdb.connect(), [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    rows = [(i, f"{x}a {x.upper()} \u039f\u0394\u039f\u03a3", f"s{x}") for i, x in enumerate(every)] + [(-1, "", ""), (-2, None, None), (-3, "\u00dfheit", "Stra\u00dfe"), (-4, "a\u03a3", "\u0130")]
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows))))))
    spark.createDataFrame(con.table("documents").to_arrow_table()).write.parquet(f"{tmp_path}/documents.parquet")
    con.register("mine", plans.QUERIES["clean_case"](spark, str(tmp_path)).toArrow())
    con.execute(f"CREATE TABLE theirs AS {plans.ORACLE['clean_case']}")
    other = "m.sentence IS DISTINCT FROM t.sentence OR m.upper IS DISTINCT FROM t.upper"
    assert con.execute(f"SELECT doc_id, text, source FROM mine m FULL JOIN theirs t USING (doc_id) JOIN documents USING (doc_id) WHERE {other} ORDER BY 1").fetchall() == []
    assert con.execute("SELECT count(*) FROM mine").fetchall() == [(len(rows),)]
    assert [one(spark, f, "\u00dfheit") for f in (text.sentence_case, lambda c: text.sentence_case(c, by_letter=True))] == ["SSheit", "\u1e9eheit"]


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "fn, before, after",
    [
        (text.trim, " ﻿ a   b \t", "a   b"),
        (text.collapse_spaces, "  a   b  ", " a b "),
        (text.collapse_spaces, "a\tb", "a\tb"),
        (text.drop_invisible, "a​b‎c", "abc"),
        (text.straight_quotes, "“a” ‘b’", "\"a\" 'b'"),
        (text.punctuation, "–…", "-..."),
        (text.apostrophes, "it’s `a", "it's 'a"),
        (text.sentence_case, "hELLO World", "Hello world"),
        (text.sentence_case, "1 UP", "1 up"),
        (text.collapse_separators, ", lead", ", lead"),
        (text.collapse_separators, "a, ; b", "a; b"),
        (text.collapse_separators, "tail -:", "tail"),
        (text.collapse_separators, "a,. b", "a. b"),
        (lambda c: text.remove_prefixes(c, []), "01 - Song", "01 - Song"),
        (lambda c: text.remove_prefixes(c, ["x"]), "- Song ", "Song"),
        (lambda c: text.remove_prefixes(c, ["01", "02"]), "01 - Song", "Song"),
        (text.featuring, "A ft B", "A feat. B"),
        (text.featuring, "A (featuring B)", "A (feat. B)"),
        (lambda c: text.normal_date(c, "year"), "1992/04/20", "1992"),
        (text.normal_date, "1992/4/2", "1992-04-02"),
        (text.normal_date, "1992-4", "1992-04"),
        (text.normal_date, "1998 (Remastered)", "1998"),
        (text.normal_date, "not a date ", "not a date"),
        (text.normal_date, "Released 1998-05-03", "1998-05-03"),
        (text.normal_date, "since 5.1998", "since 5.1998"),
        (lambda c: text.normal_date(c, "full"), "1998 x", "1998 x"),
        (lambda c: text.normal_date(c, "year-month"), "on 1998 5 3", "1998-05"),
        (text.normal_date, "1998 1999", "1998 1999"),
        (text.empty_if_blank, " ; ", ""),
        (text.empty_if_blank, "a b", "a b"),
        (lambda c: text.empty_if_blank(c, compat=True), "a b", ""),
        (text.show_duration, "3671", "1:01:11"),
        (text.show_duration, "65", "1:05"),
        (text.show_bytes, "1536", "1.5 KB"),
        (text.xml_escape, '<a & "b">', "&lt;a &amp; &quot;b&quot;&gt;"),
        (text.csv_cell, 'a,"b"', '"a,""b"""'),
        (text.folder_of, "\\a\\b\\c.mp3", "a/b"),
        (text.extension_of, ".hidden", ""),
        (text.stem_of, "a.b.mp3", "a.b"),
        (text.named_entities, "a &amp;lt; &mdash;", "a &lt; —"),
        (arrow.unescape, "a &amp; caf&#233;", "a & café"),
        (arrow.nfc, "café", "café"),
        (arrow.title_case, "the iPhone song", "The iPhone Song"),
        (arrow.title_case, "a tale of two cities", "A Tale of Two Cities"),
        (arrow.title_case, "NAME", "Name"),
        (arrow.title_case, "live via satellite", "Live via Satellite"),
        (arrow.title_case, "of 1st with vs. of", "Of 1St With vs. Of"),
    ],
)
def test_function(spark, fn, before, after):
    if fn in (text.show_duration, text.show_bytes):
        assert spark.range(1).select(fn(F.lit(int(before)))).first()[0] == after
    else:
        assert one(spark, fn, before) == after


def test_long_texts(spark):
    """Long runs of blanks take time in proportion to their length."""
    import time

    def took(fn, n):
        df = spark.createDataFrame([("y" + " " * n + "x",)], "t string").select(fn(F.col("t")))
        df.collect()
        began = time.time()
        df.collect()
        return time.time() - began

    for fn in (text.trim, text.collapse_separators, replace.strip_featured, text.normal_date):
        assert took(fn, 400_000) < 3 * max(took(fn, 200_000), 0.3)


def test_numbers(spark):
    assert one(spark, text.leading_number, "12abc") == 12
    assert one(spark, text.leading_number, "abc") is None
    assert one(spark, lambda c: text.pair(c)[1], "3/12") == 12
    assert one(spark, text.seconds, "1:02:03.5") == 3723.5
    assert one(spark, text.seconds, "x") is None


def model(a: str, b: str) -> float:
    """similarity, in plain Python."""

    def form(t):
        t = re.sub(r"(?<![A-Za-z0-9_])(?:the|a|an|and|of|in|on)(?![A-Za-z0-9_])", " ", unicodedata.normalize("NFC", t.lower()))
        return re.sub("[^a-z0-9Ѐ-ӿ一-鿿]+", " ", t).strip()

    x, y = form(a), form(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    d = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, d[0] = d[0], i
        for j, q in enumerate(y, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (p != q))
    s, t = set(x.split()), set(y.split())
    jac = len(s & t) / len(s | t)
    return max(0.7 * jac + 0.3 * (1 - d[-1] / max(len(x), len(y))), jac)


def test_similarity(spark):
    rng = random.Random(4)
    words = ["The", "beatles", "hard", "day's", "night", "of", "Ж", "é", "a", "-", "x1"]
    pairs = [("The Beatles", "Beatles"), ("Hard Day's Night", "Hard Days Night"), ("Pink Floyd", "Beethoven"), ("the of", "x"), ("", "a")]
    pairs += [(" ".join(rng.choices(words, k=rng.randint(0, 5))), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert abs(r["s"] - model(r["a"], r["b"])) < 1e-9, r
    assert got[0]["s"] == 1 and 0.5 < got[1]["s"] < 1 and got[2]["s"] < 0.2 and got[3]["s"] == 0 and got[4]["s"] == 0


@pytest.mark.parametrize(
    "find, with_, options, before, after",
    [
        ("a", "b", {}, "aAa", "bbb"),
        ("a", "b", {"ignore_case": False}, "aAa", "bAb"),
        ("a", "b", {"once": True}, "xaa", "xba"),
        ("abc", "x", {"whole": True}, "ABC", "x"),
        ("abc", "x", {"whole": True}, "ABCd", "ABCd"),
        (r"(\w+) (\w+)", "$2 $1", {"regex": True}, "a b", "b a"),
        (r"(\w)x", "$1y", {"regex": True, "once": True}, "axbx", "aybx"),
        (".", "$1", {}, "a.b", "a$1b"),
        ("", "x", {}, "a", "a"),
    ],
)
def test_replace(spark, find, with_, options, before, after):
    assert one(spark, lambda c: replace.replaced(c, find, with_, **options), before) == after


def test_bad_patterns():
    with pytest.raises(replace.BadPattern):
        replace.pattern("(", regex=True)
    with pytest.raises(replace.BadPattern):
        replace.replacement("$2", "(a)", regex=True)


def test_cleanup(spark):
    df = spark.createDataFrame([(1, "  Sonǵ ", [" a", "A ", "b", ""], "1999/1/2", 5)], "id int, title string, artists array<string>, date string, year int")
    steps = [cleanup.Step("trim", ("title", "artists")), cleanup.Step("normalizeUnicode", ("title", "artists")), cleanup.Step("removeDuplicateValues", ("artists",)), cleanup.Step("normalizeDates", ("date",))]
    r = cleanup.clean(df, steps, "date", "year").first()
    assert (r["title"], r["artists"], r["date"], r["year"]) == (unicodedata.normalize("NFC", "Song\u0301"), ["a", "b"], "1999-01-02", 1999)
    assert [c["field"] for c in r["changes"]] == ["title", "artists", "date", "year"]
    assert set(df.columns) | {"changes"} == set(r.asDict())
