import glob
import os

import duckdb
import pytest

from sightline.llm import queries as corpus
from tests.conftest import SF01


@pytest.mark.parametrize("name", sorted(corpus.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF01}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.execute(corpus.ORACLE_SQL[name])
    cols = [c[0] for c in got.description]
    df = corpus.QUERIES[name](spark, SF01)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(got.fetchall())
