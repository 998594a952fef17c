from pyspark.sql import functions as F

from florile.operators import actions, templates
from florile.sources import files, releases

SCHEMA = "id int, artist string, artists array<string>, album_artist string, album_artists array<string>, date string, year int, name string, track int, compilation boolean, comment string"


def test_steps(spark):
    df = spark.createDataFrame([(1, "A ft. B", ["A ft. B"], None, None, "1999-05", None, "07 x.mp3", None, None, "c"), (2, "A; B", None, "Z", None, None, 2001, "x.mp3", 3, None, None)], SCHEMA)
    s = actions.STEPS
    got = {r["id"]: r for r in actions.apply(df, [s["albumartist-from-artist"](), s["strip-featured"](), s["year-from-date"](), s["date-from-year"]("year-month"), s["track-number-from-filename"](), s["compilation-flag"](), s["clear-comment"]()]).collect()}
    a, b = got[1], got[2]
    assert (a["artist"], a["artists"], a["album_artist"], a["year"], a["track"], a["compilation"], a["comment"]) == ("A", ["A"], "A ft. B", 1999, 7, True, "")
    assert (b["album_artist"], b["date"], b["track"]) == ("A; B", "2001-01", 3)
    r = {x["id"]: x for x in actions.apply(df, [s["split-artists"](), s["artist-from-albumartist"]()]).collect()}
    assert r[1]["artist"] == "A ft. B" and r[2]["artists"] == ["Z"]  # the later patch wins
    none = actions.apply(df, [s["replace-text"](["comment", "artists"], "zz", "y"), s["cleanup-text"](["name"])]).collect()
    assert all(not x["changes"] for x in none)


def test_scopes(spark):
    df = spark.createDataFrame([(1, "aa b", ["a", None, "c"], {"k": "xax"}), (2, None, None, None)], "id int, title string, artists array<string>, custom map<string,string>")
    got = {r["id"]: r for r in actions.replace_in_scopes(df, ["title", "artists", "custom"], "a", "_").collect()}
    assert (got[1]["title"], got[1]["artists"], got[1]["custom"], got[1]["hits"]) == ("__ b", ["_", None, "c"], {"k": "x_x"}, 4)
    assert [tuple(c) for c in got[1]["changes"]] == [("title", "aa b", "__ b"), ("artists", "a", "_"), ("custom.k", "xax", "x_x")]
    assert got[2]["hits"] == 0 and got[2]["changes"] == []


def test_write_issues(spark):
    df = spark.createDataFrame([(1, "wav", 1, "la", ["a", "b"], "t"), (2, "flac", 1, "la", ["a", "b\x00"], "t\x01"), (3, "mp3", 0, None, None, None)], "id int, format string, images int, lyrics string, genres array<string>, title string")
    got = sorted(map(tuple, actions.write_issues(df, "id", "format", files.formats(spark), "images", "lyrics", ["genres"], ["title"]).collect()))
    assert got == [(1, "artwork", "error"), (1, "genres", "warning"), (1, "lyrics", "warning"), (2, "control-characters", "warning"), (2, "genres", "error")]


def test_releases(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"id":"1","title":"T","date":"1998-03-01","artist-credit":[{"name":"A","joinphrase":" & "},{"name":"B"}],"media":[{"position":1,"tracks":[{"position":1,"title":"x","length":61500}]},{"position":2,"tracks":[{"position":1,"title":"y"}]}],"label-info":[{"catalog-number":"C1","label":{"name":"L"}}]}\n'
        '{"id":"2","title":"U","year":"2001","artists":[{"name":"C (3)"}],"tracklist":[{"position":"A1","title":"z","duration":"1:02"}],"labels":[{"name":"M","catno":"D2"}]}\n'
    )
    got = {r["id"]: r for r in releases.read(spark, str(tmp_path / "r.json")).collect()}
    a, b = got["1"], got["2"]
    assert (a["artists"], a["year"], a["catalog_number"], a["label"], a["disc_count"], a["track_count"]) == (["A", "B"], 1998, "C1", "L", 2, 2)
    assert [tuple(t) for t in a["tracks"]] == [(1, "x", 61.5), (1, "y", None)]
    assert (b["artists"], b["year"], b["catalog_number"]) == (["C"], 2001, "D2") and b["tracks"][0]["seconds"] == 62
    df = spark.createDataFrame([("A+B", "x", "")], "artist string, release string, barcode string")
    assert df.select(releases.search_text({k: F.col(k) for k in df.columns})).first()[0] == 'artist:"A\\+B" AND release:"x"'


def test_guess(spark):
    names = ["01 - A - B.mp3", "01 x.mp3", "A - B.mp3", "x.mp3"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(templates.guess(F.col("n"))).collect()] == ["%track% - %artist% - %title%", "%track% %title%", "%artist% - %title%", "%title%"]


def test_clauses_are_described_and_counted(spark):
    from florile.catalog import bind
    from florile.operators import search

    d = spark.createDataFrame([(1, "en", 5.0), (2, "de", None), (3, None, 10.0)], "id int, lang string, n double")
    c = bind(d, "id", text={"format": "lang"}, number={"size": "n"}, haystack=("format",))
    rows = search.clause_counts(c, "format:e size:>=7.5 -de").orderBy("place").collect()
    assert [(r["clause"], r["n"]) for r in rows] == [("format: e", 2), ("size >= 7.5", 1), ("without de", 2), ("all", 0)]
    assert [(r["clause"], r["n"]) for r in search.clause_counts(c, "").collect()] == [("all", 3)]
    assert search.described(search.Clause("flag", "=", True, True)) == "not flag = true"


def test_loose_signatures(spark):
    from florile.operators.duplicates import loose_signature

    d = spark.createDataFrame([("A ", "b", 3.0), ("a", "B", 4.9), ("a", "b", 5.0), (None, None, 1.0), ("", " ", 1.0), ("x", None, None)], "a string, b string, s double")
    assert [r[0] for r in d.select(loose_signature(F.col("a"), F.col("b"), F.col("s"))).collect()] == ["a|b|2", "a|b|2", "a|b|3", None, None, "x||"]


def test_write_preview(spark):
    from florile.sinks.exports import write_preview

    was = spark.createDataFrame([(1, "a"), (2, "é"), (3, None), (4, "gone")], "id long, t string")
    now = spark.createDataFrame([(1, "a"), (2, "e,"), (3, ""), (5, "new")], "id long, t string")
    found = write_preview(was, now, "id")
    assert found.schema["id"].dataType == was.schema["id"].dataType
    assert sorted(map(tuple, found.collect())) == [(2, 4, 6), (4, 6, None), (5, None, 5)]
    assert write_preview(was.limit(0), was.limit(0), "id").count() == 0


def test_dates_in_several_styles_at_once(spark):
    from florile.functions import text

    d = spark.createDataFrame([(t,) for t in ("1992/4/2 x", "in 1992.11", "c. 1992", "1992 or 1993", "none", "", " 1992-4-31 1993-1-1", None)], "t string")
    styles = ["auto", "year", "year-month", "full"]
    rows = d.select(text.normal_dates(F.col("t"), {s: s for s in styles}).alias("all"), *[text.normal_date(F.col("t"), s).alias(f"one_{s}") for s in styles]).collect()
    assert all(r["all"][s] == r[f"one_{s}"] for r in rows for s in styles)
    assert [r["all"]["year-month"] for r in rows] == ["1992-04", "1992-11", "1992", "1992 or 1993", "none", "", "1992-04", None]
    assert rows[2]["all"]["full"] == "c. 1992"
