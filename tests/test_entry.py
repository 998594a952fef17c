"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from florile import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_oracle(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    cur = con.execute(plans.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert shown(df.columns, [tuple(r) for r in df.collect()]) == shown(columns, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "lang", "n_chars"]
    assert set(e.oracle_sql()) <= set(e.queries())
