"""Every registered query of the core against its SQL on the smallest tables; none may be empty or constant."""

import glob
import os

import duckdb
import pytest

from barloom import oracles, queries

SF_DIR = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()
QUERIES = queries.queries()
KEYS = {"symbol", "bucket", "bar_ts", "doc_id", "item_id", "query_id", "vec_id", "conv_id", "turn", "param_id", "fold", "rank", "pos", "pattern", "metric"}
#: Results that are alike for every key by the query's own meaning, or have one row.
ALIKE = {"screen_unknown", "screen_few_bars", "symbols"}
WITHOUT_SQL = {"rouge_l", "chunk_recursive"}


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        made.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return made


def test_all_but_the_named_have_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert rows
    if len(rows) > 1 and name not in ALIKE and not name.startswith(("signals_", "cross", "pattern", "break")):
        shown = [i for i, c in enumerate(names) if c not in KEYS]
        assert any(len({repr(r[i]) for r in rows}) > 1 for i in shown)
    if name in SQL:
        made = con.execute(SQL[name])
        columns = [d[0] for d in made.description]
        assert sorted(columns) == names
        assert sorted((tuple(r[columns.index(c)] for c in names) for r in made.fetchall()), key=repr) == rows
