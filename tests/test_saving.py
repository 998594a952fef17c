"""Rescans and saved versions."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from florile.operators import edits, snapshots
from florile.sinks import versions

INDEX = "id long, size long, time long, title string, year int"


def test_rescan_reads_changed_rows_alone(spark):
    before = spark.createDataFrame([(i, i, 10, f"t{i}", 2000) for i in range(50)] + [(50, None, 10, "null size", 1), (51, None, 10, "null size", 1)], INDEX)
    now = [(i, i, 10) for i in range(5, 50)] + [(60, 1, 1), (50, None, 10), (51, 3, 10)]
    now[0], now[1] = (5, 99, 10), (6, 6, 11)
    listing = spark.createDataFrame(now, "id long, size long, time long")
    read = lambda todo: todo.withColumns({"title": F.concat(F.lit("new"), "id"), "year": F.lit(2020)})
    log = spark.createDataFrame([(5, "title", "mine", 1), (6, "year", "1", 1), (6, "other", "1", 2), (7, "title", "mine", 3), (2, "title", "kept", 4), (60, "title", "early", 5)], "id long, field string, value string, seq long")
    seen = Observation()
    new = snapshots.rescan(before, listing, read, "id", ["size", "time"], ["title", "year"], log, seen)
    rows = {r["id"]: r for r in new.collect()}
    assert seen.get["n"] == 4 and len(rows) == 53
    state = {i: r["status"] for i, r in rows.items()}
    assert [i for i, s in state.items() if s == "changed"] and {i for i, s in state.items() if s == "changed"} == {5, 6, 51} and {i for i, s in state.items() if s == "gone"} == set(range(5)) and state[60] == "new" and state[50] == "same"
    assert {i: r["conflicts"] for i, r in rows.items() if r["conflicts"]} == {5: ["title"], 6: ["year"]}
    assert (rows[5]["title"], rows[7]["title"], rows[2]["title"]) == ("new5", "t7", "t2")
    over = {r["id"]: r for r in edits.overlay(new, log, "id", ["title", "year"]).collect()}
    assert (over[5]["title"], over[6]["year"], over[7]["title"], over[2]["title"], over[60]["title"]) == ("mine", 1, "mine", "kept", "early")
    # A second scan of the same listing reads nothing; what was gone stays so until it is listed again, when it is new.
    more, asked = Observation(), []
    second = snapshots.rescan(new, listing, lambda todo: asked.append(todo.count()) or read(todo), "id", ["size", "time"], ["title", "year"], log)
    assert {(r["id"], r["title"], r["status"] == "gone") for r in second.collect()} == {(i, r["title"], r["status"] == "gone") for i, r in rows.items()} and asked == [0]
    back = snapshots.rescan(second, listing.unionByName(spark.createDataFrame([(2, 2, 10)], listing.schema)), read, "id", ["size", "time"], ["title", "year"], log, more)
    assert {r["id"]: r["status"] for r in back.collect()}[2] == "new" and more.get["n"] == 1
    assert snapshots.rescan(before.limit(0), listing.limit(0), read, "id", ["size", "time"], ["title", "year"], log).count() == 0


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, title string")


def shown(df):
    return {r["id"]: r["title"] for r in df.collect()}


def test_versions(spark, tmp_path, monkeypatch):
    place, schema = str(tmp_path), table(spark, (1, "a")).schema
    assert versions.commit(table(spark, (1, "a"), (2, "b")), place, 0, "id")
    assert versions.commit(table(spark, (2, "c"), (3, None)), place, 1, "id")
    assert not versions.commit(table(spark, (1, "other")), place, 1, "id")
    after = shown(versions.state(spark, place, schema, "id"))
    assert after == {1: "a", 2: "c", 3: None} and shown(versions.state(spark, place, schema, "id", 0)) == {1: "a", 2: "b"}
    # Rows without a commit don't count, and the next try writes them over.
    monkeypatch.setattr(versions, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        versions.commit(table(spark, (1, "half"), (9, "half")), place, 2, "id")
    monkeypatch.undo()
    assert shown(versions.state(spark, place, schema, "id")) == after and not versions.committed(spark, place, 2)
    assert versions.commit(table(spark, (1, "whole")), place, 2, "id") and shown(versions.state(spark, place, schema, "id")) == {**after, 1: "whole"}
    with pytest.raises(versions.NotSaved):
        versions.commit(table(spark, (1, "x"), (1, "y")), place, 3, "id")
    versions.commit(versions.restored(spark, place, schema, "id", table(spark, (1, ""), (2, ""), (3, "")), 1), place, 4, "id")
    assert shown(versions.state(spark, place, schema, "id")) == {1: "a", 2: "b", 3: None}


def test_saved_stream(spark, tmp_path):
    """A stream that stops after a batch's rows and before its log goes on to the same state."""
    source, place = tmp_path / "in", str(tmp_path / "out")
    for n in range(3):
        spark.createDataFrame([(i, f"b{n}", n * 10 + i) for i in range(n, n + 3)], "id long, title string, _seq long").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("id long, title string, _seq long").option("maxFilesPerTrigger", 1).parquet(str(source))
    versions.save(stream, place, "id").trigger(availableNow=True).start().awaitTermination()
    schema = spark.createDataFrame([], "id long, title string").schema
    state = shown(versions.state(spark, place, schema, "id"))
    assert state == {0: "b0", 1: "b1", 2: "b2", 3: "b2", 4: "b2"}
    last = max((tmp_path / "out/log/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    versions.save(stream, place, "id").trigger(availableNow=True).start().awaitTermination()
    assert shown(versions.state(spark, place, schema, "id")) == state


def test_pasted_without_source(spark):
    c = table(spark, (1, "a"), (2, None))
    assert edits.pasted(c, c.where("id = 9"), "id", ["title"], "op").count() == 0
    assert edits.pasted(c, c.where("id = 2"), "id", ["title"], "op").count() == 0
    assert [tuple(r) for r in edits.pasted(c.where("id = 2"), c.where("id = 1"), "id", ["title"], "op", 5).collect()] == [(2, "op", "title", "a", 7)]
    assert {r["seq"] for r in edits.pasted(c.withColumn("n", F.lit(40)), c.where("id = 1"), "id", ["title"], "op", 5, "n").collect()} == {45}
