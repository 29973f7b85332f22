"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""
import math
import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from deckscope.plans.registry import QUERIES as OWN
from deckscope.sources.tables import TABLES
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() and abs(v) < 2 ** 53 else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (int, bool, str)):
        return v
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_is_registered_with_oracle_or_rows_only():
    assert set(SQL) <= set(QUERIES)
    rows_only = set(OWN) - set(SQL)
    assert all(n.startswith("ml_") or n == "export_json" for n in rows_only), rows_only
    added = set(QUERIES) - set(OWN)          # the training-data queries; their own tests hold them against plain versions
    assert all(re.fullmatch(r"op\d+_\w+|pipeline", n) for n in added), added


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    dk = con.execute(SQL[name]).df()
    sc, sr = _rows(sp)
    dc, dr = _rows(dk)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns[:3] == ["rank", "deck_name", "composite_score"]
