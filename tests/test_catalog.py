"""Every query against its SQL in DuckDB."""

from collections import Counter

import duckdb
import pytest

from inkframe import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got
    if name in catalog.ORACLE:
        names = ",".join(f'"{c}"' for c in cols)
        assert got == Counter(map(str, duck.execute(f"SELECT {names} FROM ({catalog.ORACLE[name]})").fetchall()))
