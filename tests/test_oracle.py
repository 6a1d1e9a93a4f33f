import math
from pathlib import Path

import duckdb
import pytest

from sluice.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    return db


def rows(columns, found):
    tidy = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    want = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_documents_have_all_words(spark, db):
    from sluice.functions.flatten import flat_fields
    from sluice.queries import CASES, FLAT

    want = {i: t.split(" ") for i, t in db.sql("select doc_id, text from documents").fetchall()}
    found = flat_fields(FLAT(spark, DIR), "doc", ["doc_id"]).filter("path = 'meta.more.words'").selectExpr("doc_id", "cast(value as array<string>) as words")
    assert {r.doc_id: r.words for r in found.collect()} == want
    hits = {r.doc_id for r in CASES["json_nested"].run(spark, DIR).filter("filter_name = 'array'").collect()}
    assert hits == {i for i, words in want.items() if "the" in words} != {i for i, words in want.items() if "the" in words[:5]}
