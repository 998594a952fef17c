import random

import pytest
from pyspark.sql import functions as F

from florile.catalog import bind, twin
from florile.operators import order, rules, search
from florile.operators.rules import Rule


@pytest.fixture(scope="module")
def library(spark):
    rows = spark.createDataFrame(
        [
            (1, "01 Xtal.flac", "a", "Xtal", ["Aphex Twin"], 1992, 940.0, True, None, "live take"),
            (2, "b.mp3", "a", "Other", ["A", "B"], 2001, 320.0, False, "J. Doe", None),
            (3, "c.mp3", None, None, [], None, 0.0, None, "", "x"),
        ],
        "id long, name string, folder string, title string, artists array<string>, year int, bitrate double, lossless boolean, composer string, comment string",
    )
    return bind(rows, "id", text={"title": "title", "folder": "folder", "composer": "composer", "comment": "comment", "filename": "name"}, multi={"artist": "artists"}, number={"year": "year", "bitrate": "bitrate"}, flag={"lossless": "lossless"}, name="name")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "query, found",
    [
        ("", [1, 2, 3]),
        ('xtal artist:"Aphex Twin"', [1]),
        ("year:>=2000 bitrate:>200", [2]),
        ("bitrate:>320", [1]),
        ("lossless:true", [1]),
        ("lossless:no", [2, 3]),
        ('-comment:"live take"', [2, 3]),
        ("-year:>2000", [1]),
        ("composer:!=x", [1, 2, 3]),
        ("composer:~x", []),
        ("bogus:value", []),
        ("year:199", [1]),
        ("artist:!=a", [1, 2, 3]),
        ("artist:=a", [2]),
        ("other OR xtal", []),
        ("-xtal", [2, 3]),
        ("-lossless:true", [2, 3]),
        ('"xtal', []),
        ("bitrate:>abc", []),
    ],
)
def test_query(library, query, found):
    assert ids(search.search(library, query)) == found


def test_compat(library):
    assert ids(search.search(library, "-xtal", compat=True)) == [1]
    assert ids(search.search(library, "-lossless:true", compat=True)) == [1]


def test_empty_value_is_an_error(library):
    with pytest.raises(ValueError):
        search.search(library, "year:")


def test_tokens():
    assert search.tokens("""a "b c" d:'e f' g:"h""") == ["a", '"b c"', "d:'e f'", 'g:"h']
    rng = random.Random(1)
    for _ in range(50):
        words = ["".join(rng.choice("abc:") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6))]
        assert search.tokens("  ".join(words)) == words


def test_pushed_down(spark, tmp_path, library):
    library.rows.write.parquet(str(tmp_path / "t"))
    c = bind(spark.read.parquet(str(tmp_path / "t")), "id", number={"year": "year"})
    plan = search.search(c, "year:>=2000").select("id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(year,2000" in plan.replace(".0", "")


def test_views_and_rules(library):
    assert ids(rules.view(library, "missing-metadata", 0).rows) == [1, 2, 3]  # there is no album at all
    assert ids(rules.view(library, "lossless", 0).rows) == [1]
    assert ids(rules.view(library, "artists", 0).rows) == [1, 2]
    assert ids(rules.view(library, "unknown", 0).rows) == [1, 2, 3]
    assert ids(rules.smart_playlist(library, [Rule("year", ">", "1990"), Rule("artist", "!=", "A")])) == [1]
    assert ids(rules.smart_playlist(library, [Rule("year", "!=", "1992")])) == [2, 3]
    assert ids(rules.smart_playlist(library, [])) == []


def test_order(library):
    got = [r["id"] for r in order.ordered(library, [("year", "desc"), ("title", "asc")]).collect()]
    assert got == [2, 1, 3]
    assert [r["id"] for r in order.slice_rows(library, [("title", "asc")], 1, 1).collect()] == [2]


def test_twin(spark):
    df = spark.createDataFrame([(["a"], "b"), ([], "b"), (None, "b"), (None, None)], "many array<string>, one string")
    assert [r[0] for r in df.select(twin(F.col("many"), F.col("one"))).collect()] == [["a"], [], ["b"], []]
