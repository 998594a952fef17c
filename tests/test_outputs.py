"""Playlists, exports, names, ranges and errors as data, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from florile.catalog import bind
from florile.functions import text
from florile.operators import edits, matching, order, templates
from florile.sinks import exports, playlists

TRACKS = "id int, list int, folder string, name string, artists array<string>, title string, album string, number int, seconds double, size long"
ROWS = [
    (1, 1, "/m/a", "1.mp3", ["A", "B"], " One\nmore ", "Al<bum", 1, 61.5, 10),
    (2, 1, "m/a", "x.y.mp3", None, None, None, None, None, 20),
    (3, 2, "", "3.mp3", ["C"], "Three", "", 3, 0.4, None),
]


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame(ROWS, TRACKS)


def track():
    return playlists.Track(*map(F.col, ("folder", "name", "artists", "title", "album", "number", "seconds", "size")))


def contents(df):
    return {r["list"]: r["content"] for r in df.collect()}


def test_m3u(tracks):
    got = contents(playlists.m3u_list(tracks, ["list"], [F.col("id")], track()))
    assert got[1] == "#EXTM3U\n#PLAYLIST:A, B — Al<bum\n#EXTINF:62,A, B -  One more\n#EXTALB:Al<bum\n#EXTTRACK:1\n#EXTBYT:10\n/m/a/1.mp3\n#EXTINF:-1,Unknown Artist - x.y\n/m/a/x.y.mp3\n"
    assert got[2] == "#EXTM3U\n#PLAYLIST:C\n#EXTINF:0,C - Three\n#EXTTRACK:3\n/3.mp3\n"
    plain = contents(playlists.m3u_list(tracks, ["list"], [F.col("id")], track(), absolute=False, base="../b/", extended=False))
    assert plain[1] == "../b/1.mp3\n../b/x.y.mp3\n"


def test_pls(tracks):
    got = contents(playlists.pls_list(tracks, ["list"], [F.col("id")], track(), absolute=False))
    assert got[1] == "[playlist]\nFile1=m/a/1.mp3\nTitle1=A, B -  One more\nLength1=62\nFile2=m/a/x.y.mp3\nTitle2=Unknown Artist - x.y\nNumberOfEntries=2\nVersion=2\n"


def test_xspf(tracks):
    import xml.etree.ElementTree as tree

    ns = "{http://xspf.org/ns/0/}"
    for content in contents(playlists.xspf_document(tracks, ["list"], [F.col("id")], track())).values():
        root = tree.fromstring(content.encode())
        own = root.findall(f"{ns}trackList/{ns}track")
        if len(own) == 2:
            assert (root.find(f"{ns}title").text, root.find(f"{ns}creator").text) == ("Al<bum", "A, B")
            assert [x.tag.removeprefix(ns) for x in own[0]] == ["location", "title", "creator", "album", "trackNum", "duration"] and [x.tag.removeprefix(ns) for x in own[1]] == ["location"]
            assert own[0].find(f"{ns}duration").text == "61500"


def test_exports(tracks):
    fields = {"filename": F.col("name"), "title": F.col("title"), "artist": F.array_join("artists", "; "), "album": F.col("album"), "track": F.col("number"), "size": F.col("size"), "format": F.lit("mp3")}
    lines = [r[0] for r in tracks.orderBy("id").select(exports.table_line(fields)).collect()]
    assert lines[0].startswith('1.mp3," One\nmore ",A; B,,Al<bum,1,') and lines[0].count(",") == len(exports.COLUMNS) - 1
    assert exports.table_header().count(",") == 26 and exports.table_header(False).count(",") == 15
    got = contents(exports.export(tracks, ["list"], [F.col("id")], fields, "html-report", "now"))
    assert "<h1>2 recordings</h1>" in got[1] and "written now" in got[1] and "<em>Al&lt;bum</em>" in got[1] and got[1].count("<li>") == 2
    own = contents(exports.export(tracks, ["list"], [F.col("id")], fields, None, "now", delimiter="|", text="{{count}}:{{#tracks}}{{index}}{{delimiter}}{{/tracks}}"))
    assert own == {1: "2:1|2|", 2: "1:1|"}
    whole = json.loads(contents(exports.export(tracks, ["list"], [F.col("id")], fields, "json-manifest", "now"))[1])
    assert whole["exported"] == "now" and whole["totals"]["files"] == 2 and whole["totals"]["artists"] == 2 and whole["tracks"][0]["filename"] == "1.mp3"
    for name in exports.TEMPLATES:
        assert contents(exports.export(tracks, ["list"], [F.col("id")], fields, name, "now")).keys() == {1, 2}
    for template, text in (("html-reprot", None), ("json", None), (None, None), ("txt-report", "x")):
        with pytest.raises(ValueError):
            exports.export(tracks, ["list"], [F.col("id")], fields, template, "now", text=text)


@pytest.mark.parametrize("names", [["a.x", "a.x", "a (2).x", "A.x", "a (2).x", "a (3).x"], ["b", "b (2)", "b", "b (2) (2)", "b (2)"], ["c"] * 5])
def test_made_names_are_unique(spark, names):
    df = spark.createDataFrame([(i, "f", n) for i, n in enumerate(names)], "id int, folder string, target string")
    got = {r["id"]: (r["new_name"], r["clash"]) for r in templates.without_collisions(df, ["folder"], "target", "id").collect()}
    assert len({n.lower() for n, _ in got.values()}) == len(names)
    assert all(got[i] == (n, False) for i, n in enumerate(names) if n.lower() not in [x.lower() for x in names[:i]])


def test_parse_greedy(spark):
    df = spark.createDataFrame([("a - b - c.mp3",), (" - b - .mp3",), ("none.mp3",)], "name string")
    v = templates.parse_greedy(F.col("name"), "%track% - %artist% - %title%")
    rows = df.select(v["track"].alias("track"), v["artist"].alias("artist"), v["matched"].alias("matched")).collect()
    assert [tuple(r) for r in rows] == [("a", "b", True), (None, None, False), (None, None, False)]
    v = templates.parse_greedy(F.col("name"), "%a%[%b%]%c%")
    rows = spark.createDataFrame([("x[1]y.mp3",), ("[1].mp3",)], "name string").select(v["a"].alias("a"), v["b"].alias("b"), v["coverage"].alias("c")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [("x", "1"), (None, "1")] and rows[1]["c"] == 1


def test_between(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "id int, t string")
    c = bind(df, "id", text={"t": "t"})
    full = sorted(range(9), key=lambda i: ("abc"[i % 3], i))
    got = lambda a, b: sorted(r["id"] for r in order.between(c, [("t", "asc")], a, b).collect())
    for a, b in ((0, 5), (5, 0), (4, 4)):
        i, j = sorted((full.index(a), full.index(b)))
        assert got(a, b) == sorted(full[i : j + 1])
    assert got(100, 3) == [3] and got(3, 100) == []


def test_errors_and_discard(spark):
    df = spark.createDataFrame([(1, ""), (2, "ok"), (3, "longer text")], "id int, t string")
    got = edits.with_error(df, [("commit", "long", F.length("t") > 5), ("validate", "empty", F.col("t") == "")]).orderBy("id").collect()
    assert [(r["error"], r["error_stage"]) for r in got] == [("empty", "validate"), (None, None), ("long", "commit")]
    with pytest.raises(ValueError):
        edits.with_error(df, [("other", "x", F.lit(True))])
    log = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2)], "id int, field string, value string, seq int")
    assert [r["id"] for r in edits.discard(log, spark.createDataFrame([(1,)], "id int")).collect()] == [2] and edits.discard(log).count() == 0
    plan = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "a", None)], "id int, old string, new string")
    assert [(r["id"], r["field"], r["value"]) for r in edits.rename_rows(plan, "id", "old", "new", "op").collect()] == [(1, "filename", "b")]


def test_labels(spark):
    df = spark.createDataFrame([("(17)",), ("17",), ("(17) Own ",), ("999",), (" Name ",), (None,)], "g string")
    assert [r[0] for r in df.select(text.id3_genre(F.col("g"))).collect()] == ["Rock", "Rock", "Own", "999", "Name", None]
    assert spark.range(1).select(text.show_time(F.lit(0)), text.status_label(F.lit("clean"), F.lit(False))).first()[:] == ("1970-01-01 00:00:00", "Export")


def test_scores(spark):
    df = spark.createDataFrame([(1, 2), (None, 1), (None, 2), (2, 2)], "a int, b int")
    assert [r[0] for r in df.select(matching.disc_score(F.col("a"), F.col("b"))).collect()] == [0.3, 1.0, 0.3, 1.0]
    codes = spark.createDataFrame([("1-2", "12"), ("12", "12"), (None, "12")], "a string, b string")
    assert [r[0] for r in codes.select(matching.barcode_score(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]
