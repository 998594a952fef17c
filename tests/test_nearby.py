"""Joins of what is nearly equal, against all pairs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from florile import plans
from florile.operators import nearby


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def jaccard(x, y):
    x, y = set(x), set(y)
    return len(x & y) / len(x | y) if x or y else 0


@pytest.mark.parametrize("most", [nearby.MOST, 5])
@pytest.mark.parametrize("threshold", [0.15, 0.5, 0.8, 1.0])
def test_similar_sets_together(spark, monkeypatch, threshold, most):
    """The same where sets meet on several words together, as far as the choices of words allow, and on one beyond that."""
    monkeypatch.setattr(nearby, "CROWD", 0)
    monkeypatch.setattr(nearby, "MOST", most)
    monkeypatch.setattr(nearby, "LONGEST", 7)
    test_similar_sets(spark, monkeypatch, nearby.PART if most > 5 else 3, threshold)


def test_crowded_sets(spark):
    """Sets of few words that all are frequent: they meet on several words together, and on single ones not at all."""
    words = F.array(*[F.concat(F.lit("abcd"[k]), F.floor(F.col("i") / 8**k) % 8) for k in range(4)])
    got = nearby.similar_sets(spark.range(8**4).withColumnRenamed("id", "i"), None, "i", words, 0.6)
    assert got.count() == 8**4 * 28 // 2
    own = got._jdf.queryExecution().optimizedPlan().toString()
    assert "first#" in own and "at_a#" not in own


@pytest.mark.parametrize("part", [nearby.PART, 3])
@pytest.mark.parametrize("threshold", [0.15, 0.5, 0.8, 1.0])
def test_similar_sets(spark, monkeypatch, part, threshold):
    """Hot words in most rows, rows of the same words, of one word, of none and of nulls; also with hot words dealt into parts."""
    monkeypatch.setattr(nearby, "PART", part)
    rng = random.Random(part * 100 + int(threshold * 10))
    words = [f"w{k}" for k in range(25)]
    pick = lambda: sorted({rng.choice(words[: rng.choice([3, 8, 25])]) for _ in range(rng.randrange(9))}) + (["hot"] if rng.random() < 0.7 else [])
    rows = [(i, pick(), rng.choice(["x", "y", None])) for i in range(120)]
    rows += [(200 + i, ["a", "b", "c"], "x") for i in range(4)] + [(300, [], "x"), (301, None, "x"), (302, [None, "a", "a"], "x"), (303, ["a"], "x")]
    df = spark.createDataFrame(rows, "i long, words array<string>, kind string").repartition(3)
    clean = {i: {w for w in (t or []) if w is not None} for i, t, _ in rows}
    want = {(i, j): jaccard(clean[i], clean[j]) for i in clean for j in clean if i < j and clean[i] and clean[j] and jaccard(clean[i], clean[j]) >= threshold - 1e-12}
    got = nearby.similar_sets(df, None, "i", F.col("words"), threshold)
    assert not any(x in plan(got) for x in ("NestedLoop", "Cartesian"))
    found = [((r["a"], r["b"]), r["score"]) for r in got.collect()]
    assert len(found) == len(dict(found)) and {k: round(v, 9) for k, v in found} == {k: round(v, 9) for k, v in want.items()} and len(want) > 10 * (threshold < 1)
    kinds = {i: k for i, _, k in rows}
    a, b = df.where("i % 2 = 0"), df.where("i % 2 = 1")
    blocked = {(r["a"], r["b"]) for r in nearby.similar_sets(a.where("kind IS NOT NULL"), b.where("kind IS NOT NULL"), "i", F.col("words"), threshold, ["kind"]).collect()}
    assert blocked == {(i, j) if i % 2 == 0 else (j, i) for i, j in want if (i + j) % 2 and kinds[i] == kinds[j] is not None}
    assert nearby.similar_sets(df.limit(0), None, "i", F.col("words"), threshold).count() == 0


@pytest.mark.parametrize("part", [nearby.PART, 2])
@pytest.mark.parametrize("width", [0, 0.1, 3, 1e6])
def test_band_join(spark, monkeypatch, part, width):
    monkeypatch.setattr(nearby, "PART", part)
    rng = random.Random(5)
    value = lambda: rng.choice([None, float("nan"), float("inf"), -0.0, 0.1, 0.3, -7.0, round(rng.uniform(-9, 9), 1), round(rng.uniform(-9, 9), 1), 1e15, 5.0, 5.0])
    left, right = [(i, value(), i % 3) for i in range(90)], [(i, value(), i % 3) for i in range(70)]
    a, b = spark.createDataFrame(left, "i int, x double, k int"), spark.createDataFrame(right, "j int, y double, k int")
    good = lambda v: v is not None and abs(v) < float("inf")
    near = lambda x, y: good(x) and good(y) and abs(x - y) <= width
    got = nearby.band_join(a, b, "x", "y", width, ["i"], ["k"])
    assert not any(x in plan(got) for x in ("NestedLoop", "Cartesian"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, x, k in left for j, y, m in right if k == m and near(x, y))
    assert sorted((r["i"], r["j"]) for r in nearby.band_join(a.drop("k"), b.drop("k"), "x", "y", width, ["i"]).collect()) == sorted((i, j) for i, x, _ in left for j, y, _ in right if near(x, y))
    with pytest.raises(ValueError):
        nearby.band_join(a, b, "x", "y", -1, ["i"])


@pytest.mark.parametrize("width", [0, 0.1, 40, 300, 1e6])
def test_band_between(spark, width):
    """What stands between bounds as SQL rounds them: numbers at the very edge, infinite ones and NaN, large ones that a bound jumps over, nulls."""
    rng = random.Random(11)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.1, 300.1, 1e15, 2**53 + 2.0, 1e17, 1e17 + 48, 1e18, 1e18 + 384, 1e300, -1e300]
    near = [round(v + d, 2) for v in (rng.uniform(-999, 9999) for _ in range(150)) for d in (0, width, -width)]
    left, right = [(i, v) for i, v in enumerate([*odd, *near])], [(i, v) for i, v in enumerate([*odd, *near[::3]])]
    a, b = spark.createDataFrame(left, "i int, x double"), spark.createDataFrame(right, "j int, y double")
    con = duckdb.connect()
    for name, df in (("a", a), ("b", b)):
        con.register(name, df.toArrow())
    want = con.execute(f"SELECT i, j FROM a JOIN b ON x BETWEEN y - {width}::DOUBLE AND y + {width}::DOUBLE ORDER BY ALL").fetchall()
    got = nearby.band_join(a, b, "x", "y", width, ["i"], between=True)
    assert not any(x in plan(got) for x in ("NestedLoop", "Cartesian"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_tolerance_at_the_edge(spark, tmp_path):
    """tolerance_pairs and its SQL agree on balances that are just as far apart as the tolerance."""
    rng, con = random.Random(4), duckdb.connect()
    balance = [round(rng.uniform(-999, 9999), 2) for _ in range(300)]
    customer = [(3 * i + k, i % 5, round(v + d, 2)) for i, v in enumerate(balance) for k, d in enumerate((300, -300, 40))]
    supplier = [(i, i % 5 + i % 2, v) for i, v in enumerate(balance)]
    for name, key, rows in (("customer", "cust", customer), ("supplier", "supp", supplier)):
        spark.createDataFrame(rows, f"{name[0]}_{key}key long, {name[0]}_nationkey int, {name[0]}_acctbal double").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, plans.QUERIES["tolerance_pairs"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(plans.ORACLE["tolerance_pairs"]).fetchall())


def test_hot_keys_are_dealt(spark, monkeypatch):
    """No task gets more than a part of a key's left rows."""
    monkeypatch.setattr(nearby, "PART", 50)
    left = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"))
    one, two = nearby.dealt(left, spark.createDataFrame([(1,), (950,)], "k long"), ["k"], ["i"])
    sizes = {(r["k"], r["part"]): r["count"] for r in one.groupBy("k", "part").count().collect()}
    assert max(sizes.values()) < 100 and sum(sizes.values()) == 1000
    assert one.join(two, ["k", "part"]).count() == 901 and two.count() == 19


def test_pairs_of_names_are_scored_once(spark, tmp_path):
    """similarity_pairs and its SQL agree on many parts of few names and on odd ones, and scores are made of different pairs of names, not of parts."""
    rng, con = random.Random(9), duckdb.connect()
    names = ["red bolt", "the red bolt", "Red Bolts", "blue bolt", "old  rod", "old rod", "rod old", "a", "the", "", None, "gear", "red red bolt", "bolt bolt"]
    rows = [(k, rng.choice(names), rng.choice(["B1", "B1", "B1", "B2", None]), rng.choice(["t", "t", "u"]), 7) for k in range(1500)] + [(1, "red bolt", "B1", "t", 7), (None, "red bolt", "B1", "t", 7), (9999, "red bolt", "B1", "t", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = plans.QUERIES["similarity_pairs"](spark, str(tmp_path))
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    scored = [x for x in lines if "levenshtein" in x]
    assert scored and not any("Join" in x or "Aggregate" in x for x in scored)
    mine = sorted(tuple(r) for r in got.collect())
    assert mine == sorted(con.execute(plans.ORACLE["similarity_pairs"]).fetchall()) and len(mine) > 50_000
