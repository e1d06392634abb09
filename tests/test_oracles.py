"""Every core query against its SQL on the smallest tables."""

import importlib
import os
import pathlib

import duckdb
import pytest

from codeloom.plans import registry

DATA = os.environ.get("CODELOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = sorted(p.stem for p in pathlib.Path(DATA).glob("*.parquet")) if os.path.isdir(DATA) else []
PAIRS = [(n, m) for m in map(importlib.import_module, registry.MODULES) for n in m.ORACLES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet' )" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.skipif(not TABLES, reason="the test tables are not here")
@pytest.mark.parametrize(("name", "module"), PAIRS, ids=[n for n, _ in PAIRS])
def test_query_equals_its_sql(spark, con, name, module):
    got = module.QUERIES[name](spark, DATA)
    want = con.sql(module.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_names_are_unique_and_complete():
    names = [n for m in map(importlib.import_module, registry.MODULES) for n in m.QUERIES]
    assert len(names) == len(set(names)) > 90
    for m in map(importlib.import_module, registry.MODULES):
        assert set(m.ORACLES) <= set(m.QUERIES)
