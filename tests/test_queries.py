"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tickloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalog.queries()[name](spark, DIR)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    key = lambda row: [(v is None, isinstance(v, (int, float)), round(v, 3) + 0.0 if isinstance(v, float) else v) if v is not None else (True, False, 0) for v in row]
    text = lambda rows: sorted(rows, key=lambda r: str(key(r)))
    got = text([tuple(r[c] for c in cols) for r in df.collect()])
    want = text(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})").fetchall())
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
