"""Every query with an oracle against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessella.plans import registry

DATA = Path("/root/testdata/sf0.01")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    # small steps of float sums are not differences
    fine = lambda v: None if isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.6g}" if isinstance(v, float) else v
    return [names[i] for i in order], sorted(repr(tuple(fine(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, str(DATA))
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in ORACLES:
        expected = duck.sql(ORACLES[name])
        assert canonical(got.columns, rows) == canonical(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_reads_a_table(name, spark, tmp_path):
    """Without the folder's tables no query can be built, so each reads one of them."""
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        QUERIES[name](spark, f"file://{tmp_path}/none").limit(1).collect()
