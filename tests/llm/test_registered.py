"""Every registered query of the subpackage runs on the smallest tables, and gives the rows of its SQL where it has one."""
import os

import pytest

FOLDER = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(FOLDER):
    pytest.skip("the test tables aren't here", allow_module_level=True)

from tidelog.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[table[n].to_pylist() for n in names]), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, con, name):
    got = rows(QUERIES[name](spark, FOLDER).toArrow())
    if name in SQL:
        assert got == rows(con.execute(SQL[name]).to_arrow_table())
    else:
        assert got[0] and got[1]
