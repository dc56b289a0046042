import duckdb
import pytest

from ledgerlens.llm.oracle import ORACLE
from ledgerlens.llm.queries import QUERIES

from .conftest import SMALL


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark", "embeddings"):
        base.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = base.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda f: sorted(map(str, f[columns].itertuples(index=False, name=None)))
    assert rows(want) == rows(got)
