"""Every query of the library's own operators against its SQL twin in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from vigilframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def text(x: object) -> str:
        if x is None or isinstance(x, float) and pd.isna(x) or x is pd.NA:
            return "null"
        return f"{float(x):.7g}" if not isinstance(x, (str, bool)) and isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)

    return sorted(tuple(text(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got, expected = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)
