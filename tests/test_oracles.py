"""Every query with a SQL twin gives the twin's rows."""

import duckdb
import pytest

from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c



def close(a, b):
    return a == b or all(
        x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b)
    )


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    twin = duck.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(twin.columns)
    at = [twin.columns.index(c) for c in cols]
    order = lambda r: tuple((x is None, str(round(x, 3) + 0.0) if isinstance(x, float) else str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=order)
    want = sorted((tuple(r[i] for i in at) for r in twin.fetchall()), key=order)
    assert len(got) == len(want) > 0
    assert all(map(close, got, want))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_isolation_ranks_outliers_first(spark):
    from tidemark.operators import scorers

    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(300)] + [(999, [90.0, -80.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    forest = scorers.fit_isolation(df, "id", "x", trees=100, sample=301)
    top = scorers.isolation_score(df, "x", forest).orderBy("isolation", ascending=False).first()
    assert top["id"] == 999
