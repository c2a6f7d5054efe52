"""Named queries against their SQL on the smallest tables."""

import os

import pytest

from rankloom.plans import core, files, more  # noqa: F401 - each module registers its queries

D = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"create view \"{f[:-8]}\" as select * from '{D}/{f}'")
    df = core.QUERIES[name](spark, D)
    rel = c.sql(core.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(x) for x in cols]
    assert sorted(str(tuple(norm(r[x]) for x in cols)) for r in df.collect()) == sorted(str(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
