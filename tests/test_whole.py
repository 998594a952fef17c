"""Queries that do the whole job beside those whose SQL says less."""

from florile import plans


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))


def test_benchmark_passages(spark, tmp_path):
    """An item inside a sentence is found, and texts that differ after 60 characters aren't the same."""
    item = "Alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec."
    other = item.replace("oscar papa quebec", "romeo sierra tango")
    table(spark, tmp_path, "benchmark", [(1, item), (2, "zulu yankee")], "item_id long, text string")
    table(spark, tmp_path, "documents", [(1, f"Before it, {item.lower()} and more"), (2, other), (3, "nothing of it"), (4, "a zulu yankee b"), (5, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["best"], r["whole"]) for r in plans.QUERIES["benchmark_passages"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2)}
    assert got[1, 1] == got[4, 2] == (1.0, True) and 0.5 < got[2, 1][0] < 1 and not got[2, 1][1]


def test_similar_names(spark, tmp_path):
    """Names of a brand are compared whatever their type and size, each pair once."""
    rows = [(1, "red green blue", "B1", "t", 1), (2, "red green black", "B1", "u", 2), (3, "red green blue", "B1", "v", 3), (4, "red green black", "B2", "u", 2), (5, "other", "B1", "t", 1)]
    table(spark, tmp_path, "part", rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    got = plans.QUERIES["similar_names"](spark, str(tmp_path)).collect()
    pair = [r for r in got if r["b"]]
    assert sorted(r["p_partkey"] for r in pair) == [1, 2, 3] and len({(r["a"], r["b"], r["score"]) for r in pair}) == 1
    assert sorted(r["p_partkey"] for r in got if not r["b"]) == [1, 3]
