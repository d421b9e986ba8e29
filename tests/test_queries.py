"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from codeweft.plans import codegraph, extraction, integrity

MODULES = (codegraph, extraction, integrity)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}


@pytest.fixture(scope="module")
def duck(smallest):
    c = duckdb.connect()
    for p in Path(smallest).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, smallest, duck, name):
    df = QUERIES[name](spark, smallest)
    cols = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*cols).collect())
    assert len(cols) == len(set(cols))
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(row[names.index(c)] for c in cols) for row in r.fetchall())


def test_entry_module_has_unique_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= sum(len(m.QUERIES) for m in MODULES)
