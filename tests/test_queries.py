"""Every query with an SQL counterpart gives the same rows in DuckDB.

Queries on learners take several seconds each; they run with ``MANYLABEL_ALL=1``.
"""

import math
import os

import duckdb
import pytest

from manylabel.plans import load_all
from manylabel.plans.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
load_all()
QUICK = [
    n for n in ORACLES if QUERIES[n].__module__.rsplit(".", 1)[1] in ("catalogue", "ingest")
] + ["tfidf", "linear_well", "nb_margins"]
NAMES = list(ORACLES) if os.environ.get("MANYLABEL_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    return str(int(v)) if isinstance(v, (bool, int)) else str(v)


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(map(cell, r)) for r in zip(*columns))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = rows(QUERIES[name](spark, sf_dir).toArrow())
    want = rows(duck.sql(ORACLES[name]).to_arrow_table())
    assert got == want
