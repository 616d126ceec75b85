"""Every query of the record operators against its SQL, at the smallest scale."""

import duckdb
import pytest

from siftloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    sql = duck.execute(ORACLES[name])
    names = [d[0] for d in sql.description]
    want = sql.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(names, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_vector_statistics_counts_above_the_whole_limit(spark, tmp_path):
    """Values between mean + sd and the sum of the two rounded ones, on either side; null and empty vectors."""
    vectors = [(0, [0.0, 1 / 64], 0), (1, [0.0, 0.0, 1.6e-5], 0), (2, [5.0], 0), (3, [], 0), (4, None, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(ORACLES["vector_statistics"]).fetchall()
    got = sorted(tuple(r) for r in QUERIES["vector_statistics"](spark, str(tmp_path)).collect())
    assert got == sorted(want)
    assert [r[3] for r in got] == [0, 1, 0, 0, None]
