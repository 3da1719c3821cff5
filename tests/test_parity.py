"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from orbweave import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


#: Queries that must leave out what a raster has and the table has not.
RAGGED = ["class_file", "distance_file", "distance_surface", "object_model_file", "smoothed_file"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, base, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if name not in queries.SQL:
        assert rows
        return
    said = base.execute(queries.SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall())


@pytest.mark.parametrize("name", RAGGED)
def test_query_of_a_table_whose_last_row_is_not_full(spark, base, tmp_path, name):
    base.execute(f"COPY (SELECT * FROM embeddings WHERE vec_id < 483) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    found = queries.QUERIES[name](spark, str(tmp_path))
    columns = found.columns
    want = own.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert len(want) == 483 and sorted(tuple(map(plain, r)) for r in found.collect()) == sorted(tuple(map(plain, r)) for r in want)
