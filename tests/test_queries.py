"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from ledgerweave import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v).removesuffix(" 00:00:00")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    frame = registry.queries()[name](spark, SF)
    rows = sorted(tuple(map(plain, r)) for r in frame.select(*sorted(frame.columns)).collect())
    text = registry.oracle_sql().get(name)
    if text is None:
        assert rows
        return
    rel = sql.sql(text)
    names = sorted(rel.columns)
    assert names == sorted(frame.columns)
    assert rows == sorted(tuple(map(plain, r)) for r in rel.select(*[f'"{n}"' for n in names]).fetchall())
