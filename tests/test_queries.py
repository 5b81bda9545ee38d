from pathlib import Path

import duckdb
import pytest

from structjson.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def _plain(v) -> str:
    if v is None or str(v) in ("<NA>", "nan", "None"):
        return ""
    return str(v) if isinstance(v, (str, bool)) else f"{float(v):g}"


def _rows(df, cols):
    return sorted(tuple(map(_plain, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    assert _rows(got, cols) == _rows(want, cols)
