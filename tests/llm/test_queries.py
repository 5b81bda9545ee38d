from pathlib import Path

import duckdb
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")
from structjson.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


def _rows(df, cols):
    plain = lambda x: "" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = QUERIES[name](spark, str(DATA)), con.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert _rows(got.toPandas(), cols) == _rows(want.df(), cols)
