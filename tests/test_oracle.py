"""Every named query against its SQL, value for value."""

import glob
import os

import duckdb
import pyarrow as pa
import pytest

from gondola.oracle import ORACLES
from gondola.queries import queries

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[None if x is None else str(x) if not isinstance(x, float) else repr(x) for x in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True), key=repr)


def kinds(table: pa.Table) -> dict[str, str]:
    return {n: str(table.schema.field(n).type).replace("large_", "").split("[")[0] for n in table.column_names}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    made, wanted = queries()[name](spark, DATA).toArrow(), duck.execute(ORACLES[name]).to_arrow_table()
    assert kinds(made) == kinds(wanted)
    assert rows(made) == rows(wanted)


def test_only_fitted_trees_lack_sql():
    assert set(queries()) - set(ORACLES) == {"gbt_forecast"}
