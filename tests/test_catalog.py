"""Every registered query of the core against its SQL on the small tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkcase.plans import queries as catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def sorted_rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(lambda v: str(list(v)) if isinstance(v, list | np.ndarray) else v)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLE_SQL:
        pd.testing.assert_frame_equal(sorted_rows(got), sorted_rows(duck.sql(catalog.ORACLE_SQL[name]).df()), check_dtype=False, rtol=0, atol=1.1e-6)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())
