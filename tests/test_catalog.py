"""Each registered query of the engine with an oracle gives what DuckDB gives."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("LODESTONE_DATA", "/root/testdata/sf0.001")
from lodestone.plans import catalog  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(rows):
    def one(x):
        return tuple(x) if isinstance(x, list) else x

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    if name in catalog.ORACLE:
        rel = duck.execute(catalog.ORACLE[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == plain([tuple(r[i] for i in at) for r in rel.fetchall()])
    else:
        assert got
