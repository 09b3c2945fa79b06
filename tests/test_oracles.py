"""Each registered query against its SQL, whole tables on both sides."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith(("int", "float", "uint", "Int", "Float")):
            df[c] = df[c].astype(float).round(5)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, data, duck, name):
    got, want = plain(entry.queries()[name](spark, data).toPandas()), plain(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_every_query_without_sql_runs(spark, data):
    llm = {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql()) - llm):
        assert entry.queries()[name](spark, data).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).columns
