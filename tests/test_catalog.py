"""The queries of catalog_functions against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessera import catalog, catalog_functions

SF = Path("/root/testdata/sf0.001")
NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == catalog_functions.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in SF.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(got.columns)
    want = db.execute(catalog.ORACLE_SQL[name])
    assert sorted(c[0] for c in want.description) == columns
    want = want.df()[columns]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
    assert rows(got.select(*columns).toPandas()) == rows(want)
