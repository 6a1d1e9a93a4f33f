import math
from pathlib import Path

import duckdb
import pytest

from sluice.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


def rows(columns, found):
    tidy = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    want = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
