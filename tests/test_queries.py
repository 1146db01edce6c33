import duckdb
import pytest

from pubspark.plans.adapter import TABLES
from pubspark.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    form = lambda x: None if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else int(x) if isinstance(x, bool) else x
    return sorted((tuple(map(form, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(rel.columns) == cols
        assert got == plain(rel.select(*cols).fetchall())


def test_year_range_and_page_errors(spark):
    from pubspark.operators.search import page
    from pubspark.operators.stats import year_range

    df = spark.range(3).selectExpr("cast(id AS int) AS yr")
    for bad in ((2000, None), (None, 2000), (2001, 2000)):
        with pytest.raises(ValueError):
            year_range(df, *bad)
    with pytest.raises(ValueError):
        page(df, ["yr"], None, 2)
    assert [r[0] for r in page(df, ["yr"], 1, 1).collect()] == [1]
