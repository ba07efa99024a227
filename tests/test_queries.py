"""Every registered query of the engine against its SQL, on the smallest tables; the fold against SQL by recursion of its own."""

import os

import pytest

from brandloom import flow_oracles, flows, oracles, queries
from tests.test_operators import fold

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = {**queries.QUERIES, **flows.QUERIES}, {**oracles.ORACLES, **flow_oracles.ORACLES}
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        path = f"{FOLDER}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def shown(rows, order):
    plain = lambda v: None if v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    found = database.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert shown(df.collect(), [df.columns.index(c) for c in order]) == shown(found.fetchall(), [names.index(c) for c in order])


def test_the_fold_of_the_table(spark):
    rows = sorted(QUERIES["identity_resolve_fold"](spark, FOLDER).collect(), key=lambda r: r.page_id)
    want = fold([(r.slug, r.domain) for r in rows])
    pairs = {(r.identity_id, w) for r, w in zip(rows, want, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)
