import random
import struct

from pyspark.sql import functions as F

from florile.catalog import bind
from florile.operators import duplicates, edits, matching, stats, templates
from florile.operators.matching import Signal
from florile.sinks import exports, playlists
from florile.sources import files
from florile.streaming import edit_log


def test_duplicates(spark):
    rows = [(1, "h1", None, 10, True), (2, "h1", "s", 30, False), (3, "h2", "s", 20, True), (4, None, "t", 5, False), (5, "h3", "t", 7, False), (6, "h3", None, 7, False)]
    df = spark.createDataFrame(rows, "id long, hash string, sig string, size long, lossless boolean")
    found = duplicates.members(df, "id", {"exact": F.col("hash"), "metadata": F.col("sig")}, [F.col("lossless"), F.col("size")], F.col("size"))
    got = {(r["kind"], r["key"]): (r["n"], r["reclaimable"], r["keeper"]) for r in duplicates.groups(found).collect()}
    assert got == {("exact", "h1"): (2, 30, 1), ("metadata", "s"): (2, 30, 3), ("metadata", "t"): (2, 5, 5), ("exact", "h3"): (2, 7, 5)}
    again = df.join(found.where("NOT is_keeper").select("id"), "id", "left_anti")
    left = duplicates.groups(duplicates.members(again, "id", {"exact": F.col("hash"), "metadata": F.col("sig")}, [F.col("size")], F.col("size"))).collect()
    assert not left


def test_duplicates_same_members_collapse(spark):
    df = spark.createDataFrame([(1, "h", "s", "f"), (2, "h", "s", "f")], "id long, hash string, sig string, print string")
    found = duplicates.members(df, "id", {"exact": F.col("hash"), "metadata": F.col("sig"), "fingerprint": F.col("print")}, [F.lit(1)], F.lit(1))
    assert {r["kind"] for r in found.collect()} == {"fingerprint"}


def test_tag_signature(spark):
    df = spark.createDataFrame([("A ", "b|c", None, ""), ("a", "b", "c", None)], "p string, q string, r string, s string")
    assert [r[0] for r in df.select(duplicates.tag_signature([F.col(c) for c in "pqrs"])).collect()] == [None, "a|b|c|"]


def test_confidence(spark):
    row = spark.range(1)
    full = [Signal("artist", F.lit(1.0)), Signal("barcode", F.lit(1.0))]
    assert row.select(matching.confidence(full)).first()[0] == 100
    half = [Signal("artist", F.lit(1.0)), Signal("barcode", F.lit(0.0)), Signal("catalog", F.lit(1.0), F.lit(False))]
    assert row.select(matching.confidence(half)).first()[0] == 33
    assert row.select(matching.confidence([Signal("artist", F.lit(1.0), F.lit(False))])).first()[0] == 0
    assert row.select(matching.verdict(F.lit(99), F.lit(True))).first()[0] == "likely"
    assert [r["signal"] for r in row.select(matching.explained(half).alias("w")).first()["w"]] == ["artist", "barcode"]


def test_stats(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["a"], "y"), (3, None, "y"), (4, [" "], None)], "id long, v array<string>, k string")
    assert [(r["value"], r["n_rows"]) for r in stats.collections(df, F.col("v")).collect()] == [("a", 2), ("b", 1)]
    assert stats.distinct_counts(df, {"k": F.col("k")}, {"v": F.col("v")}).first().asDict() == {"k": 2, "v": 3}
    r = stats.common_value(df, [], "k", "id").first()
    assert (r["common"], r["mixed"]) == ("y", True)


def test_edits(spark):
    records = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, n int")
    log = spark.createDataFrame([(1, 1, "name", "x"), (2, 1, "name", ""), (3, 2, "n", "7"), (4, 2, "n", None)], "seq long, id long, field string, value string")
    got = {r["id"]: (r["name"], r["n"], r["dirty"]) for r in edits.overlay(records, log, "id", ["name", "n"]).collect()}
    assert got == {1: ("", 5, True), 2: ("b", None, True)}
    undone = edits.undo_last(log, 1)
    got = {r["id"]: (r["name"], r["n"]) for r in edits.overlay(records, undone, "id", ["name", "n"]).collect()}
    assert got == {1: ("x", 5), 2: ("b", 7)}
    assert not edits.diff(records, edits.overlay(records, log.limit(0), "id", ["name"]).drop("dirty"), "id", ["name", "n"]).collect()


def test_templates(spark):
    df = spark.createDataFrame([(1, "Xtal", ["Aphex Twin"], ["Electronic", "Ambient"], 2, None)], "id long, title string, artists array<string>, genres array<string>, track int, composer string")
    c = bind(df, "id", text={"title": "title", "composer": "composer"}, multi={"artist": "artists", "genre": "genres"}, number={"track": "track"})
    make = lambda t, **k: df.select(*[x.alias(n) for x, n in zip(templates.generate(c, t, **k), ("path", "missing"))]).first()
    assert make("%track% - %artist% - %title%")["path"] == "02 - Aphex Twin - Xtal"
    assert make("%artist%/%track% %title%")["path"] == "Aphex Twin/02 Xtal"
    assert make("%track% %composer% %title%")["missing"] == ["composer"]
    assert make("%genre%")["path"] == "Electronic Ambient"
    assert make("%genre%", sanitise=False)["path"] == "Electronic / Ambient"
    assert make(r"100\% %title%")["path"] == "100% Xtal"
    names = spark.createDataFrame([("AC/DC: Back?",), ("///",)], "x string")
    assert [r[0] for r in names.select(templates.sanitised(F.col("x"))).collect()] == ["AC DC Back", "Unknown"]
    v = templates.parse(F.lit("02 - Aphex Twin - Xtal.mp3"), "%track% - %artist% - %title%")
    r = spark.range(1).select(*[x.alias(k) for k, x in v.items()]).first()
    assert (r["track"], r["artist"], r["title"]) == ("02", "Aphex Twin", "Xtal") and r["coverage"] > 0.7
    r = spark.range(1).select(*[x.alias(k) for k, x in templates.parse(F.lit("x.mp3"), "%a% - %b%").items()]).first()
    assert not r["matched"] and r["coverage"] == 0


def test_template_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abcXY", k=5)), rng.randint(1, 99)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, title string, track int")
    c = bind(df, "id", text={"title": "title"}, number={"track": "track"})
    path, _ = templates.generate(c, "%track% - %title%")
    named = df.withColumn("file", F.concat(path, F.lit(".mp3")))
    back = templates.parse(F.col("file"), "%track% - %title%")
    assert all(r["title"] == r["t"] and r["track"] == r["n"] for r in named.select("title", "track", back["title"].alias("t"), back["track"].cast("int").alias("n")).collect())


def test_collisions(spark):
    df = spark.createDataFrame([(1, "f", "A.mp3"), (2, "f", "a.mp3"), (3, "g", "a.mp3")], "id long, folder string, target string")
    assert {r["id"]: r["new_name"] for r in templates.without_collisions(df, ["folder"], "target", "id").collect()} == {1: "A.mp3", 2: "a (2).mp3", 3: "a.mp3"}


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', "x, y"), (2, "b", None)], "n int, title string, note string")
    order = [F.col("n")]
    doc = exports.render_document(df.withColumn("g", F.lit(1)), ["g"], order, "<l>{{#tracks}}<i>{{title}}</i>{{/tracks}}</l>", {"title": F.col("title")}, "html").first()["content"]
    assert doc == "<l><i>a &quot;q&quot;</i><i>b</i></l>"
    exports.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(str(tmp_path / "csv")).orderBy("n").collect()
    assert back[0]["title"] == 'a "q"' and back[0]["note"] == "x, y"
    exports.write_lines(df, "title", order, str(tmp_path / "txt"), header="head")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "txt")).collect()][:1] == ["head"]
    m3u = playlists.m3u(df.withColumn("g", F.lit(1)), ["g"], order, playlists.m3u_entry(F.col("title"), F.lit(61.5), F.lit("/p"))).first()["content"]
    assert m3u.startswith("#EXTM3U\n#EXTINF:62,a") and m3u.count("#EXTINF") == 2


def test_files(spark, tmp_path):
    d = tmp_path / "music" / "sub"
    d.mkdir(parents=True)
    tag = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + b"Album".ljust(30, b"\0") + b"1999" + b"c".ljust(28, b"\0") + b"\0\x07\x11"
    (d / "a.mp3").write_bytes(b"\xff\xfb\x90\x00" + b"\0" * 50 + tag)
    (d / "b.flac").write_bytes(b"fLaC\0\0\0\x22" + b"\0" * 10 + ((44100 << 44) | (1 << 41) | (15 << 36) | 44100 * 180).to_bytes(8, "big") + b"\0" * 16)
    (d / "c.wav").write_bytes(b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 48000, 192000, 4, 16))
    (d / "empty.mp3").write_bytes(b"")
    (d / "note.txt").write_bytes(b"x")
    rows = files.scan(spark, str(tmp_path / "music"))
    tags, flac, wav = files.id3v1(F.col("content")), files.flac_properties(F.col("content")), files.wav_properties(F.col("content"))
    got = {r["name"]: r for r in rows.select("name", "folder", files.sniff(F.col("content"), F.col("name")).alias("format"), tags["title"].alias("title"), tags["track"].alias("track"), flac["seconds"].alias("seconds"), wav["sample_rate"].alias("rate")).collect()}
    assert set(got) == {"a.mp3", "b.flac", "c.wav"}  # Spark leaves out files of 0 bytes
    assert (got["a.mp3"]["format"], got["a.mp3"]["title"], got["a.mp3"]["track"]) == ("mp3", "Title", 7)
    assert got["b.flac"]["seconds"] == 180 and got["c.wav"]["rate"] == 48000
    assert got["b.flac"]["title"] is None and got["c.wav"]["seconds"] is None


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    log = [(i, rng.randint(1, 4), rng.choice(["edit", "edit", "undo"]), float(i)) for i in range(200)]
    schema = "seq long, id long, action string, value double"
    for k in range(4):
        spark.createDataFrame(log[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    edit_log.undoable(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: r["s"] for r in spark.read.parquet(out).groupBy("id").agg(F.max_by(F.struct("n_edits", "n_undone", "value"), "batch").alias("s")).collect()}
    for i in {x[1] for x in log}:
        stack, undone = [], 0
        for _, _, action, value in (x for x in log if x[1] == i):
            if action == "edit":
                stack = [*stack, value][-100:]
            elif stack:
                stack.pop()
                undone += 1
        assert (got[i]["n_edits"], got[i]["n_undone"], got[i]["value"]) == (len(stack), undone, stack[-1] if stack else None)
