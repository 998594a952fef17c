"""Bytes read late, broken texts, open keys, lists in parts."""

import json
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from florile.operators import keys
from florile.sinks import ordered, playlists
from florile.sources import late, records, releases


def _scans(plan):
    """Every scan of an executed plan: the columns that it reads and the rows that it gave."""
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            found.append((set(p.requiredSchema().fieldNames()), p.metrics().apply("numOutputRows").value()))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_late_columns_are_read_for_the_chosen_alone(spark, tmp_path):
    place = str(tmp_path / "t")
    spark.range(0, 40_000, 1, 1).select("id", (F.col("id") % 7).alias("g"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("wide")).write.option("parquet.block.size", 1 << 20).option("parquet.page.row.count.limit", 1000).parquet(place)
    rows = spark.read.parquet(place)
    out = late.fetched(late.first_of(rows.select("id", "g").where("id >= 39000"), ["g"], [F.col("id")], 2), rows, "id", ["wide"])
    found = out.collect()
    assert sorted(r["id"] for r in found) == list(range(39000, 39014)) and all(len(r["wide"]) == 512 for r in found)
    scans = _scans(out._jdf.queryExecution().executedPlan())
    assert sorted("wide" in names for names, _ in scans) == [False, True]
    assert [n for names, n in scans if "wide" in names][0] < 20_000  # row groups beyond the chosen ids aren't read
    assert late.fetched(rows.select("id").limit(0), rows, "id", ["wide"]).count() == 0


def test_pictures(spark):
    def block(kind, body, last=0):
        return bytes([kind + last]) + len(body).to_bytes(3, "big") + body

    def pic(kind, mime, data, claims=None):
        return b"".join((kind.to_bytes(4, "big"), len(mime).to_bytes(4, "big"), mime, (2).to_bytes(4, "big"), b"xy", (7).to_bytes(4, "big"), (8).to_bytes(4, "big"), bytes(8), (claims or len(data)).to_bytes(4, "big"), data))

    files = [b"fLaC" + block(0, bytes(34)) + block(6, pic(3, b"image/png", b"\x89PNG")) + block(6, pic(4, b"", b"", 9)) + block(6, b"short") + block(6, pic(4, b"image/gif", b"GIF8"), 128), b"fLaC", b"RIFFxxxx", b"", None]
    d = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, c binary").withColumn("p", late.flac_pictures(F.col("c")))
    out = {r["i"]: r["x"] for r in d.select("i", F.transform("p", lambda p: F.struct(p["kind"], p["mime"], p["width"], p["height"], late.picture_bytes(F.col("c"), p))).alias("x")).collect()}
    assert [tuple(x) for x in out[0]] == [(3, "image/png", 7, 8, b"\x89PNG"), (4, "image/gif", 7, 8, b"GIF8")]
    assert [out[i] for i in (1, 2, 3, 4)] == [[], [], [], []]


CASES = {
    None: ["absent"], "": ["empty"], " \n\t": ["empty"], "{": ["broken"], '{"k":1': ["broken"], '{"k":1} x': ["broken"], '{"k":1,"k":2}': ["broken"], "<a>": ["broken"], "[1]": ["no object"], "[1] 2": ["broken"], '"a\\" b"': ["no object"], "7 up": ["broken"], '"' + "\\n" * 50_000 + '"': ["no object"], "7": ["no object"], "null": ["no object"], "{}": [],
    '{"k":"x"}': ["k: no bigint"], '{"k":[1],"it\'s":{"a":1}}': ["k: no bigint"], '{"k":null}': [], '{"k":5,"more":1}': [], ' {"k":"6","on":"perhaps"} ': ["on: no boolean"],
}


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id int, `a text` string")
    seen = Observation()
    all_ = records.checked(rows, "a text", {"k": "bigint", "it's": "string", "on": "boolean"})
    assert {r["a text"]: r["errors"] for r in all_.collect()} == CASES
    good, bad = records.parted(all_, str(tmp_path / "r"), seen)
    n = sum(not e for e in CASES.values())
    assert seen.get == {"rows": len(CASES), "bad": len(CASES) - n} and good.count() == n and bad.count() == len(CASES) - n
    assert {r["a text"]: r["record"]["k"] for r in good.collect()} == {"{}": None, '{"k":null}': None, '{"k":5,"more":1}': 5}
    assert {r["a text"]: (r["record"]["k"], r["record"]["it's"]) for r in bad.where("record.k IS NOT NULL OR record.`it's` IS NOT NULL").collect()} == {' {"k":"6","on":"perhaps"} ': (6, None), '{"k":[1],"it\'s":{"a":1}}': (None, '{"a":1}')}
    assert "bad=false" in (plan := good._jdf.queryExecution().executedPlan().toString()) or "NOT bad" in plan
    assert records.checked(rows.limit(0), "a text", {"k": "bigint"}).count() == 0


def test_a_broken_service_leaves_the_others_alone(spark):
    own = spark.createDataFrame([('{"id":"1","title":"a","year":"1999"}',), ('{"id":"2","title":"b"}',)], "value string")
    answers = releases.fan_out({"good": own, "down": spark.createDataFrame([("502 Bad Gateway",)], "value string"), "silent": own.limit(0)})
    assert sorted((r["service"], r["id"], r["year"]) for r in releases.hits(answers).collect()) == [("good", "1", 1999), ("good", "2", None)]
    assert [(r["service"], r["text"], r["errors"]) for r in answers.where(F.size("errors") > 0).collect()] == [("down", "502 Bad Gateway", ["broken"])]


def test_frequent_values_are_exact(spark):
    """One value has a third of all rows, some have just the share, some just less, and most are found once."""
    n, share = 60_000, 0.01
    v = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") < 4 * 900, F.concat(F.lit("at"), F.floor(F.col("id") / 900))).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("rare"), "id"))
    d = spark.range(n).select(v.alias("v"))
    counts = {r["v"]: r["n"] for r in d.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    assert {r["v"]: r["n"] for r in keys.frequent(d.repartition(16), "v", share).collect()} == {k: c for k, c in counts.items() if c >= share * total}
    at = 600 / total
    assert {r["v"] for r in keys.frequent(d, "v", at).collect()} == {"hot", "at0", "at1", "at2", "at3"}
    assert keys.frequent(d, "v", at + 1e-6).count() == 1 and keys.frequent(d.where("v IS NULL"), "v", share).count() == 0
    for bad in (0, 1e-9, 1.5):
        with pytest.raises((ValueError, ZeroDivisionError)):
            keys.frequent(d, "v", bad)


def test_keys_become_columns_and_nothing_is_lost(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "A": "2", "z": None, "b": "3"}, "x"), (2, {"a": "4"}, "y"), (3, {}, "z"), (4, None, "w")], "id int, m map<string,string>, custom_b string")
    assert keys.frequent_keys(rows, "m", 0.3) == ["a"]
    out = {r["id"]: r.asDict() for r in keys.widened(rows, "m", ["A", "a", "b", "none"]).collect()}
    assert out[1] == {"id": 1, "custom_b": "x", "custom_A": "2", "custom_none": None, "rest": '{"a":"1","b":"3","z":null}'}
    assert (out[2]["rest"], out[3]["rest"], out[4]["rest"], out[4]["custom_A"]) == ('{"a":"4"}', None, None, None)
    assert keys.widened(rows, "m", []).columns == ["id", "custom_b", "rest"]


def _text(place, name):
    return b"".join(p.read_bytes() for p in sorted((Path(place) / f"list={name}").glob("part-*"))).decode()


@pytest.fixture
def tracks(spark):
    """A list with most of the rows, some with a few, one with a single row without anything."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 100 < 97, "long").otherwise(F.concat(F.lit("l"), F.col("id") % 700)).alias("list"), F.concat(F.lit("a&b "), F.col("id") % 9).alias("artist"))
    return rows.withColumn("list", F.when(F.col("id") == 99, F.lit("none")).otherwise(F.col("list"))).repartition(11)


def _track():
    some = lambda c: F.when(F.col("id") != 99, c)
    return playlists.Track(F.lit("f"), F.concat("id", F.lit(".mp3")), some(F.array("artist")), some(F.concat(F.lit("t\n"), "id")), some(F.lit("Al<bum")), some(F.col("id") % 12), some(F.col("id") / 7), some(F.col("id")))


def _write_pls(rows, by, order, t, place):
    ordered.write_pls(rows, by, order, t, place, place + "-sorted")


@pytest.mark.parametrize("write, small", [(ordered.write_m3u, playlists.m3u_list), (ordered.write_xspf, playlists.xspf_document), (_write_pls, playlists.pls_list)])
def test_lists_in_parts_have_the_bytes_of_small_ones(spark, tracks, tmp_path, write, small):
    place = str(tmp_path / "lists")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more lines than a task is to have
    try:
        write(tracks, "list", [F.col("artist"), F.col("id")], _track(), place)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = {r["list"]: r["content"] for r in small(tracks, ["list"], [F.col("artist"), F.col("id")], _track()).collect()}
    assert {p.name[5:] for p in Path(place).glob("list=*")} == set(wanted) and len(wanted) > 5
    assert all(_text(place, name) == text for name, text in wanted.items())
    assert len(list((Path(place) / "list=long").glob("part-*"))) > 4  # no task had it whole
    back = ordered.read_lists(spark, place).collect()
    assert {name: "\n".join(v for _, v in sorted((r["number"], r["value"]) for r in back if r["list"] == name)) + "\n" for name in wanted} == wanted


def test_manifests_in_parts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, 'q"'), ("b", None, "n"), ("b", 1, "n"), (None, 1, "null"), ("", 2, "empty"), ("a/b=c", 1, "sign")], "list string, k int, t string")
    place = str(tmp_path / "m")
    ordered.write_json(rows, "list", [F.col("k"), F.col("t")], F.struct("k", "t"), place)
    lines = {}
    for r in sorted(ordered.read_lists(spark, place).collect(), key=lambda r: r["number"]):
        lines.setdefault(r["list"], []).append(r["value"])
    found = {name: json.loads("\n".join(own)) for name, own in lines.items()}
    assert found == {"a": {"files": 2, "tracks": [{"k": 1, "t": 'q"'}, {"k": 2, "t": "x"}]}, "b": {"files": 2, "tracks": [{"t": "n"}, {"k": 1, "t": "n"}]}, ordered.NAMELESS: {"files": 2, "tracks": [{"k": 1, "t": "null"}, {"k": 2, "t": "empty"}]}, "a/b=c": {"files": 1, "tracks": [{"k": 1, "t": "sign"}]}}
    ordered.write_lists(rows.limit(0), "list", [F.col("k")], F.col("t"), str(tmp_path / "empty"), F.lit("head"))
    assert not list((tmp_path / "empty").glob("list=*"))
