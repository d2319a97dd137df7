"""Every query with SQL gives the rows that DuckDB gives; the others run."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.conftest import DATA
from tidemark.plans import load  # noqa: F401
from tidemark.plans import registry

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _text(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return ""
    return str(v)[:10] if hasattr(v, "year") else str(v)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=df.index)
    for c in sorted(df.columns):
        s = df[c]
        numeric = pd.api.types.is_numeric_dtype(s) and not pd.api.types.is_bool_dtype(s)
        out[c] = s.astype(float).round(5) + 0.0 if numeric else s.map(_text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(a: pd.Series, b: pd.Series) -> bool:
    x, y = pd.to_numeric(a, errors="coerce"), pd.to_numeric(b, errors="coerce")
    return bool(((a == b) | (a.isna() & b.isna()) | ((x - y).abs() <= 2e-5 * (1 + x.abs()))).all())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE:
        assert len(got)
        return
    want = duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = normal(got), normal(want)
    assert not [c for c in a.columns if not same(a[c], b[c])]
