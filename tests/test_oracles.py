"""Every engine query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from hindsight.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def text(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        return repr(round(float(x), 6) + 0.0) if isinstance(x, (int, float)) else str(x)

    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_repeats(spark, name):
    """Queries beyond SQL give rows, and the same ones again."""
    first = QUERIES[name](spark, SF)
    assert first.count() > 0
    assert rows(first.toPandas()) == rows(QUERIES[name](spark, SF).toPandas())
